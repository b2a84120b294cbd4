"""Vellum: a Spark-first engine for measuring, auditing and repairing document collections."""
