"""tidemark: event-study analytics as composable Spark DataFrame operators."""
