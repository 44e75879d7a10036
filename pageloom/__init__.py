"""Codepoint statistics, load-condition analysis and patch planning on Spark."""
