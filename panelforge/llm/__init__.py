"""Training-data operators: tokenising, filtering, deduplication, search and packing.

Every operator is a function from DataFrames to a DataFrame.  Nothing else in the
library imports this subpackage.
"""
