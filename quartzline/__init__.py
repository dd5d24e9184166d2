"""Data jobs on tables, written as Spark DataFrame plans."""
