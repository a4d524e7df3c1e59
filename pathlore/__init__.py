"""Behavioural event-log analytics on Spark DataFrames.

Every operator is a function from DataFrames to a lazy DataFrame in long form.
"""

__version__ = "0.1.0"
