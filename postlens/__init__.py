"""Post classification and corpus analytics as PySpark DataFrame transformations."""
