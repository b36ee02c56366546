"""Stock-and-flow analytics as Spark DataFrame operators."""
