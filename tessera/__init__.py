"""Record linkage on Spark: operators, functions and plans over DataFrames."""
