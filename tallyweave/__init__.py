"""A PySpark engine that reconciles item descriptions with a master catalog."""
