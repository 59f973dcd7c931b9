"""skyframe: Spark-native hourly observation engine.

Reshapes wide metric tables and nested payloads into one keyed observation table,
keeps it current with last-wins merges and keyed upserts, classifies condition
texts, derives row-offset forecasting features, samples, scales, trains and
scores ``pyspark.ml`` models and reports classification metrics as tables.
"""

__version__ = "0.1.0"
