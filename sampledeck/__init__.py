"""Analytics of sampled signals as Spark DataFrame transformations."""
