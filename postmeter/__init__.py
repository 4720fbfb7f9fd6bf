"""Fleet-metric and mail-archive analytics as Spark DataFrame operators."""
