"""lexweave: graph-augmented retrieval over legal text, as DataFrame plans on Spark."""

__version__ = "0.1.0"
