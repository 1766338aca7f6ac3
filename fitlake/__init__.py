"""Trial time series and fit-run analytics as Spark DataFrame operators."""
