"""sondage: table profiling and data preparation on PySpark."""
