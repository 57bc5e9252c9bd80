"""markloom: markup lexing and corpus preparation as Spark DataFrame expressions."""
