"""adlattice: Spark-native search, ingest and data-preparation engine for job postings."""

__version__ = "0.1.0"
