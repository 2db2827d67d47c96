"""Document-structure analytics as composable Spark DataFrame operators."""
