"""Software-license usage analytics on Spark: every computation is a DataFrame -> DataFrame function."""
