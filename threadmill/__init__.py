"""threadmill: a Spark-first analytics engine for discussion-thread corpora."""
