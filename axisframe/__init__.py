"""axisframe: concept annotation and concept-based retrieval on PySpark DataFrames."""

__version__ = "0.1.0"
