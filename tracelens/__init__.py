"""Visual analytics over large time series on Spark."""
