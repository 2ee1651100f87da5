"""Fleet analytics on Spark: health, drift, election and history of replicated databases."""
