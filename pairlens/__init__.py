"""Match analytics on Spark: relational verbs, text kit, lookup, scoring and evaluation."""

__version__ = "0.1.0"
