"""quernspark: retrieval and its evaluation as Spark jobs."""
