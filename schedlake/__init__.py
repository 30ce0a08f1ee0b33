"""Job-schedule and job-execution analytics as Spark DataFrame operators."""
