"""ledgerloom: a PySpark-native analytics engine for financial-audit data."""

__version__ = "0.1.0"
