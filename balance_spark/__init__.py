"""Supply-and-demand balances over tidy time series, on Spark."""
