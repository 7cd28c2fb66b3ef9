"""Point-in-time analytics over multi-source price quotes, as Spark jobs."""
