"""Page-capture analytics on Spark DataFrames.

Nothing is imported eagerly: each subpackage stands alone.
"""

__version__ = "0.1.0"
