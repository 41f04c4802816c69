"""tessera: profile, validate, generate and score relational data with Spark plans."""

__version__ = "0.1.0"
