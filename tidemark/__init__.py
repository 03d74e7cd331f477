"""Timed-interval and text analytics on PySpark."""
