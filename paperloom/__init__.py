"""paperloom: document intelligence over DataFrames of documents."""

__version__ = "0.1.0"
