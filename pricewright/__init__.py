"""Retail price intelligence as lazy DataFrame-to-DataFrame operators on Spark."""
