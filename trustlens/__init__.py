"""Channel-quality and ad-fraud analytics as Spark DataFrame plans."""
