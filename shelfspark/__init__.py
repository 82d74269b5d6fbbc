"""Retail analytics jobs on Spark: audits, reports, star schema, incremental pipeline."""
