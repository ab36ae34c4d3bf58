"""Motion, imaging and corpus analytics on PySpark."""
