"""Tempora: longitudinal event analytics expressed as Spark DataFrame plans."""
