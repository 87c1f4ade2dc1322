"""auditweave: provenance and audit analytics as PySpark DataFrame operators."""
