"""Observational treatment-effect ranking, expressed as Spark DataFrame jobs."""
