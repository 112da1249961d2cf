"""Ride pace analytics on PySpark."""
