"""Document-corpus analytics as DataFrame and Spark SQL plans."""
