"""crowdweave: audience-network analytics and training-data operators as Spark jobs."""
