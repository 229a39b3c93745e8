"""factloom: fact tables, graphs and corpus preparation on Spark DataFrames."""
