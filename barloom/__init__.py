"""barloom: bar-series features, labels and strategy evaluation as Spark DataFrame jobs."""
