"""Match-tracking analytics as Spark DataFrame operators."""
