"""tillroll: receipt and document analytics on Spark DataFrames."""
