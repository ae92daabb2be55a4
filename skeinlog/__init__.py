"""Log analytics on Spark: parsing, storing, querying and following log streams with DataFrames."""
