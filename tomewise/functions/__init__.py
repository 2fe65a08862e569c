"""Scalar functions: SQL expressions where SQL can say it, pandas UDFs for what needs Unicode rules."""
