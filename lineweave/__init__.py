"""lineweave: measures and searches large collections of text and source files on Spark."""

__version__ = "0.1.0"
