"""marlgraph: relational tables, change feeds and texts as a multi-tenant property graph on PySpark."""

__version__ = "0.1.0"
