"""Retail offer analytics expressed as Spark DataFrame jobs."""
