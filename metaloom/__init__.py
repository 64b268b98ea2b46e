"""metaloom: web-metadata analytics on Spark DataFrames."""
