"""Spark-first analytics over populations of aligned time series and the tables around them."""
