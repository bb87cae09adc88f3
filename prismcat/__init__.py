"""prismcat: catalog analytics as composable, lazily evaluated PySpark DataFrame operators."""
