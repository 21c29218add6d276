"""wayfold: road-network, map and ride analytics on PySpark."""
