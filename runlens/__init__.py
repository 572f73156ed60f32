"""runlens: grade and analyse agent benchmark runs with Spark DataFrames."""

__version__ = "0.1.0"
