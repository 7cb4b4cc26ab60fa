"""prodlens: product-content analytics on PySpark."""
