"""SQL-workload analytics and data operators expressed as Spark DataFrame plans."""
