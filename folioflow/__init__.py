"""Document dataflow on Spark: pages, lines, spans and blocks as ordered DataFrames."""
