"""folioscope: page-structured document analytics on Spark DataFrames."""
