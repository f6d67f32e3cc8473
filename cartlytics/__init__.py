"""cartlytics: distributed commerce and A/B-experiment analytics on Spark DataFrames.

Every operator takes DataFrames plus explicit parameters and returns a lazy
DataFrame; nothing is collected inside an operator.
"""

__version__ = "0.1.0"
