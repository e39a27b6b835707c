"""Analytics over the data around language-model services, on Spark DataFrames."""
