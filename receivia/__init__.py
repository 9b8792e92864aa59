"""Sales, receivables and data-quality analytics as PySpark DataFrame operators."""
