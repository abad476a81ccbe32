"""A PySpark engine for long-term knowledge stores."""
