"""Search, scoring and reporting over pages of many organisations, as Spark plans."""
