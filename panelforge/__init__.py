"""panelforge: demand analytics over panels of time series, on Spark."""
