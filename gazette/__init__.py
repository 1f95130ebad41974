"""gazette: a Spark-first analytics engine for editorial feeds, market series and text corpora."""
