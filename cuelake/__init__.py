"""Caption and speech-event analytics as composable Spark DataFrame operators."""
