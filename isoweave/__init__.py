"""Spark-first long-read transcriptomics and corpus preparation on DataFrames."""
