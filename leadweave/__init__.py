"""Business-contact analytics on PySpark: linking, golden records, enrichment, scoring."""
