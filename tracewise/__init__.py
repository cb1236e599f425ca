"""tracewise: explanation-evaluation analytics as composable Spark DataFrame operators."""
