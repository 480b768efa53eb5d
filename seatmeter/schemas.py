"""Column layouts of the stored tables and of the records taken from status dumps."""

from __future__ import annotations

SERVERS = (
    "id bigint, hostname string, description string, type string, cacti_id string, webui string, "
    "created_at timestamp, updated_at timestamp"
)
FEATURES = (
    "id bigint, server_hostname string, name string, version string, vendor_daemon string, "
    "total_licenses int, used_licenses int, expiration_date timestamp, last_updated timestamp, is_active boolean"
)
FEATURE_USAGE = (
    "id bigint, server_hostname string, feature_name string, date date, time string, users_count int"
)
LICENSE_EVENTS = (
    "id bigint, event_date date, event_time string, event_type string, feature_name string, "
    "username string, reason string"
)
ALERTS = (
    "id bigint, server_hostname string, feature_name string, alert_type string, message string, "
    "severity string, sent boolean, sent_at timestamp, created_at timestamp"
)
ALERT_EVENTS = "id bigint, datetime timestamp, type string, hostname string"
SERVER_STATUS = (
    "hostname string, service string, master string, version string, message string, last_checked timestamp"
)
CHECKOUTS = (
    "server_hostname string, feature_name string, username string, host string, checked_out_at timestamp, "
    "version string, license_version string"
)
DUMPS = "dump_id string, host string, server_type string, captured_at timestamp, text string"

TABLES = {
    "servers": SERVERS,
    "features": FEATURES,
    "feature_usage": FEATURE_USAGE,
    "license_events": LICENSE_EVENTS,
    "alerts": ALERTS,
    "alert_events": ALERT_EVENTS,
}

# Identity of a license pool and of a usage sample.
POOL_KEY = ["server_hostname", "name", "version", "expiration_date"]
SERIES_KEY = ["server_hostname", "feature_name"]
SAMPLE_KEY = ["server_hostname", "feature_name", "date", "time"]
EVENT_KEY = ["event_date", "event_time", "feature_name", "username"]

SERVICE_STATES = ["up", "down", "warning"]
SEVERITIES = ["info", "warning", "critical"]
EVENT_TYPES = ["IN", "OUT", "DENIED"]
