"""ledgerloom: procurement-style records and their documents, processed with Spark DataFrames."""
