"""A log and lakehouse engine made of Spark plans."""
