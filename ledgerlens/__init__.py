"""ledgerlens: feature and evaluation operators for transaction tables, on Spark."""

__version__ = "0.1.0"
