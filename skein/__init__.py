"""skein: source code as a graph of Spark DataFrames."""
