"""staylens: lodging-market analytics as DataFrame-in, DataFrame-out Spark jobs."""
