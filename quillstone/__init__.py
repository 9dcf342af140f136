"""quillstone: schema-checked relational datasets on Spark DataFrames."""

__version__ = "0.1.0"
