"""tallyspark: payment-reconciliation analytics and data preparation on plain PySpark."""

__version__ = "0.1.0"
