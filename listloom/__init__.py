"""listloom: listing analytics as Spark DataFrame plans."""
