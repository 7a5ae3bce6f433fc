"""Schema of the transaction table and the fixed values the queries depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of the base table.
TXN_SCHEMA = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("nameOrig", T.StringType()),
        T.StructField("oldbalanceOrg", T.DoubleType()),
        T.StructField("newbalanceOrig", T.DoubleType()),
        T.StructField("nameDest", T.StringType()),
        T.StructField("oldbalanceDest", T.DoubleType()),
        T.StructField("newbalanceDest", T.DoubleType()),
        T.StructField("isFraud", T.LongType()),
        T.StructField("isFlaggedFraud", T.LongType()),
    ]
)
TXN_COLUMNS: list[str] = [f.name for f in TXN_SCHEMA.fields]
BALANCE_COLUMNS = ["oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results).
# Transaction types: CASH_IN, CASH_OUT, DEBIT, PAYMENT, TRANSFER.
# Merchant accounts: destination name starting with "M".
# Large-transfer cut-off behind isFlaggedFraud and rules A/B: 200000.
# Rule C cut-off: 100000 on TRANSFER only.
# Amount bands (upper-inclusive): 1000, 10000, 50000, 100000, 200000 ->
#   "0-1K", "1K-10K", "10K-50K", "50K-100K", "100K-200K", else "200K+".
# Origin-balance bands: = 0 -> "0"; upper-inclusive 1000, 10000, 100000 ->
#   "1-1K", "1K-10K", "10K-100K", else "100K+".
# Minimum segment size for the combined segment reports: 100 rows.
# Top segments kept in the dashboard table: 20.
# Rule names, as published in the threshold comparisons:
#   "Threshold_A: amount > 200K"
#   "Threshold_B: TRANSFER/CASH_OUT and amount > 200K"
#   "Threshold_C: TRANSFER and amount > 100K"
#   "Threshold A: Amount > 200K"
#   "Threshold B: TRANSFER/CASH_OUT > 200K"
#   "Threshold C: TRANSFER > 100K"
# ---------------------------------------------------------------------------
TXN_TYPES = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
MERCHANT_PREFIX = "M"
LARGE_AMOUNT = 200000
TRANSFER_WATCH_AMOUNT = 100000
AMOUNT_CUTS = (1000, 10000, 50000, 100000, 200000)
AMOUNT_LABELS = ("0-1K", "1K-10K", "10K-50K", "50K-100K", "100K-200K", "200K+")
BALANCE_CUTS = (1000, 10000, 100000)
BALANCE_LABELS = ("1-1K", "1K-10K", "10K-100K", "100K+")
BALANCE_ZERO_LABEL = "0"
MIN_SEGMENT_ROWS = 100
TOP_SEGMENTS = 20
RULE_NAMES_ANALYSIS = (
    "Threshold_A: amount > 200K",
    "Threshold_B: TRANSFER/CASH_OUT and amount > 200K",
    "Threshold_C: TRANSFER and amount > 100K",
)
RULE_NAMES_DASHBOARD = (
    "Threshold A: Amount > 200K",
    "Threshold B: TRANSFER/CASH_OUT > 200K",
    "Threshold C: TRANSFER > 100K",
)

# One step is one simulated hour; step 1 starts at EPOCH (a Monday, so weekly
# periods and windows start on Mondays).
EPOCH = "2024-01-01 00:00:00"
HOURS_PER_WEEK = 168

# Money is summed exactly as a decimal with this many decimals and cast to DOUBLE at the end
# (functions.exprs.money_scale sets another number).
MONEY_DIGITS = 2
MONEY_TYPE = f"decimal({16 + MONEY_DIGITS},{MONEY_DIGITS})"
