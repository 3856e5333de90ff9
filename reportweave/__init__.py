"""Report-estate analytics on Spark: DataFrame in, DataFrame out."""
