"""dialoom: conversational-memory analytics as declarative PySpark plans."""
