"""Spark-native opportunity radar and backtest engine for market-style time series."""
