"""Ownership-network analytics on Apache Spark: DataFrame in, DataFrame out."""
