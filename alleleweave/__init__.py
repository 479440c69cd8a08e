"""Personal genomes as one-hot sequences, on Spark."""

__version__ = "0.1.0"
