"""webloom: crawl-style dataflow and extraction on Spark DataFrames."""

__version__ = "0.1.0"
