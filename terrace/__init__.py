"""Match analytics as Spark jobs: every operator takes and returns DataFrames."""

__version__ = "0.1.0"
