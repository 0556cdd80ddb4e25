"""tapeloom: market-data analytics as Spark jobs, DataFrame in and DataFrame out."""
