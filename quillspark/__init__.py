"""Classical machine learning as Spark DataFrame plans."""
