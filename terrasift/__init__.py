"""terrasift: spatial screening analytics as PySpark DataFrame pipelines."""
