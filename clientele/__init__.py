"""Purchase-behaviour analytics as composable Spark DataFrame operators."""
