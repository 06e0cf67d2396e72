"""Word-structure analytics over DataFrames."""
