"""tersemill: text compression and text analytics on Spark DataFrames."""
