"""veriset: a Spark-native engine that audits the integrity of datasets and benchmarks."""

__version__ = "0.1.0"
