"""Analytics over localisation corpora on Spark DataFrames."""
