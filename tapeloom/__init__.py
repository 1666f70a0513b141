"""Market-tape jobs on Spark: DataFrame in, DataFrame out."""
