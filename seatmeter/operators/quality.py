"""Checks of configured servers: host notation and server type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The supported types and the patterns of a host. The reasons given below are texts of the same kind.
SUPPORTED_TYPES = ["flexlm", "rlm"]
_IPV4 = r"^(\d{1,3}\.){3}\d{1,3}$"
_OCTETS = r"^((25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(25[0-5]|2[0-4]\d|[01]?\d?\d)$"
_NAME = r"^[a-zA-Z0-9]([a-zA-Z0-9\-.]*[a-zA-Z0-9])?$"


def valid_host(host: Column) -> Column:
    """An IPv4 address with octets up to 255, or a name with at least one letter."""
    named = host.rlike(_NAME) & host.rlike("[a-zA-Z]")
    return F.when(host.rlike(_IPV4), host.rlike(_OCTETS)).otherwise(named)


def host_reason(hostname: Column) -> Column:
    """Why a `port@host`, `host:port` or `host` notation is bad; NULL when it is good."""
    text = F.regexp_replace(hostname, r"^\s+|\s+$", "")
    at_form, colon_form = F.contains(text, F.lit("@")), F.contains(text, F.lit(":"))
    at, colon = F.instr(text, "@"), F.instr(text, ":")
    port_text = (
        F.when(at_form, F.substr(text, F.lit(1), at - 1)).when(colon_form, F.substr(text, colon + 1))
    )
    host = (
        F.when(at_form, F.substr(text, at + 1)).when(colon_form, F.substr(text, F.lit(1), colon - 1)).otherwise(text)
    )
    has_port = at_form | colon_form
    port = F.when(port_text.rlike(r"^[+-]?\d+$"), port_text.try_cast("bigint"))
    return (
        F.when(F.coalesce(hostname, F.lit("")) == "", "hostname is required")
        .when(has_port & port.isNull(), F.concat(F.lit("invalid port number: "), port_text))
        .when(has_port & ~port.between(1, 65535), "port must be between 1 and 65535")
        .when(has_port & (host == ""), "host cannot be empty")
        .when(~valid_host(host), F.concat(F.when(has_port, "invalid host: ").otherwise("invalid hostname: "), host))
    )


def type_reason(server_type: Column) -> Column:
    cleaned = F.lower(F.trim(server_type))
    return (
        F.when(F.coalesce(server_type, F.lit("")) == "", "server type is required")
        .when(~cleaned.isin(SUPPORTED_TYPES), F.concat(F.lit("unsupported server type: "), cleaned))
    )


def host_quality(servers: DataFrame) -> DataFrame:
    """Servers with the verdict on their host notation and type."""
    return (
        servers.withColumn("host_reason", host_reason(F.col("hostname")))
        .withColumn("type_reason", type_reason(F.col("type")))
        .withColumn("is_valid", F.col("host_reason").isNull() & F.col("type_reason").isNull())
    )
