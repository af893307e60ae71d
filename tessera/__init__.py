"""tessera: point-in-time panel research and corpus preparation as Spark jobs."""
