"""Wellbeing-signal analytics expressed as Spark DataFrame jobs."""
