"""tritlake: ternary-signature retrieval and classification on PySpark."""
