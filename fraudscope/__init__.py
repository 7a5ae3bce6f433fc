"""fraudscope: payment-screening analytics on Spark DataFrames.

Data-quality checks, fraud KPIs, risk segmentation, review-rule comparison,
weekly monitoring with alerts, and delimited / Parquet exports over one flat
transaction table, as batch or Structured Streaming jobs.
"""

from fraudscope.schema import TXN_COLUMNS, TXN_SCHEMA

__all__ = ["TXN_COLUMNS", "TXN_SCHEMA"]
