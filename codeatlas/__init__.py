"""codeatlas: code-intelligence analytics and corpus preparation on PySpark."""
