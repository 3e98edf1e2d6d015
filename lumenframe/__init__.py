"""Frame-signal analytics on Spark: DataFrame-to-DataFrame operators keyed by video."""
