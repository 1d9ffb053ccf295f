"""quoin: facade-matching analytics and relational geometry on PySpark."""
