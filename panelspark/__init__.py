"""Panel time series and training-data operators on Spark."""
