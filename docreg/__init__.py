"""docreg: table operators for document-digitisation registries, built on PySpark."""

__version__ = "0.1.0"
