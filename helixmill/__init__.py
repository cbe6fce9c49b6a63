"""Variant matching, annotation and triage as PySpark DataFrame operators."""
