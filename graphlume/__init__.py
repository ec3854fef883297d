"""Node-comparison analytics and large-table preparation on Spark DataFrames."""

__version__ = "0.1.0"
