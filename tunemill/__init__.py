"""tunemill: PySpark operators for technical corpora, telemetry and their evaluation."""
