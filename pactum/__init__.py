"""pactum: declarative data contracts, compiled to Spark DataFrame plans."""

__version__ = "0.1.0"
