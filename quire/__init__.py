"""quire: document analytics and corpus preparation on PySpark."""
