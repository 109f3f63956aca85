"""Graph-property jobs on Spark: every operator takes and returns DataFrames keyed by ``graph_id``."""
