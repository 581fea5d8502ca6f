"""Ticker signals from social posts and news, expressed as Spark plans."""

__version__ = "0.1.0"
