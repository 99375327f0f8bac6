"""tracewright: evidence analytics over repository history, as Spark DataFrame operators."""
