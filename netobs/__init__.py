"""netobs: passive network telemetry as Spark DataFrame jobs."""
