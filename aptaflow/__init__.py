"""Aptamer (HT-SELEX) analytics on Spark DataFrames."""
