"""Critical-path analysis of distributed dataflow executions on Spark DataFrames."""
