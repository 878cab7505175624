"""Spark-first analytics over graphs of candidate instructions, plus corpus operators in ``llm``."""
