"""mailsieve: explainable mail-risk analytics as Spark DataFrame pipelines."""
