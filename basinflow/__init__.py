"""River-gage and weather analytics on Spark."""
