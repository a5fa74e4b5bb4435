"""readloom: sequencing-read analytics and lossless block archives on Spark."""

__version__ = "0.1.0"
