"""Text search and link analysis on PySpark DataFrames."""
