"""DuckDB oracle SQL, written independently of the Spark plans.

Each oracle is ``WITH tx AS (<fixture>), ... SELECT ...`` over the
pre-registered ``events`` view. Conventions shared with the Spark side:
counts BIGINT (DuckDB sums are HUGEINT, so cast), money as
``CAST(SUM(CAST(x AS DECIMAL(18,2))) AS DOUBLE)``, rates as
``ROUND(CAST(num AS DOUBLE) * 100.0 / NULLIF(den, 0), d)``, NULLS LAST on
every ORDER BY, and a total order under every LIMIT.
"""

from __future__ import annotations

COLS = (
    "step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, "
    "nameDest, oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud"
)
ALL_ASC = ", ".join(f"{c.strip()} ASC NULLS LAST" for c in COLS.split(","))


def all_asc_except(*first: str) -> str:
    return ", ".join(f"{c.strip()} ASC NULLS LAST" for c in COLS.split(",") if c.strip() not in first)


FIXTURE_CTE = """
ev AS (
    SELECT event_id AS e, ts, user_id, event_type,
        CASE WHEN event_id % 1019 = 0 THEN NULL
             WHEN event_type = 'error' THEN 'TRANSFER'
             WHEN event_type = 'click' THEN 'CASH_OUT'
             WHEN event_type = 'signup' THEN 'CASH_IN'
             WHEN event_type = 'purchase' THEN 'PAYMENT'
             ELSE 'DEBIT' END AS t,
        CASE WHEN event_id % 997 = 0 THEN NULL
             WHEN event_id % 991 = 0 THEN CAST(0 AS DECIMAL(18,2))
             WHEN event_id % 983 = 0 THEN CAST(-12.5 AS DECIMAL(18,2))
             ELSE CAST(CAST(value AS DECIMAL(12,2)) * 4000
                       + CAST(event_id % 100 AS DECIMAL(12,2)) * 0.01 AS DECIMAL(18,2)) END AS amt,
        CAST(CASE event_id % 5
             WHEN 0 THEN 0
             WHEN 1 THEN 1 + (event_id * 31) % 1000
             WHEN 2 THEN 1001 + (event_id * 31) % 9000
             WHEN 3 THEN 10001 + (event_id * 31) % 90000
             ELSE 100001 + (event_id * 31) % 900000 END AS DECIMAL(18,2)) AS ob,
        CAST(CASE WHEN event_type = 'purchase' THEN (CASE WHEN event_id % 11 = 0 THEN NULL ELSE 0 END)
                  WHEN event_id % 7 = 0 THEN 0
                  ELSE (event_id * 17) % 500000 END AS DECIMAL(18,2)) AS od
    FROM events
),
ev2 AS (
    -- every 500th event appears twice (exact duplicate rows)
    SELECT * FROM ev
    UNION ALL
    SELECT * FROM ev WHERE e % 500 = 0
),
tx AS (
    SELECT
        date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) + 1 AS step,
        t AS type,
        CAST(amt AS DOUBLE) AS amount,
        'C' || CAST(user_id AS VARCHAR) AS nameOrig,
        CAST(ob AS DOUBLE) AS oldbalanceOrg,
        CAST(CASE WHEN e % 3 = 0 THEN 0 ELSE ob - amt END AS DOUBLE) AS newbalanceOrig,
        CASE WHEN e % 1013 = 0 THEN NULL
             WHEN event_type = 'purchase' THEN 'M' || CAST(e % 97 AS VARCHAR)
             ELSE 'C' || CAST((user_id * 7 + e) % 150 AS VARCHAR) END AS nameDest,
        CAST(od AS DOUBLE) AS oldbalanceDest,
        CAST(CASE WHEN e % 4 = 0 THEN od ELSE od + amt END AS DOUBLE) AS newbalanceDest,
        CAST(CASE WHEN e % 1009 = 0 THEN NULL
                  WHEN t IN ('TRANSFER', 'CASH_OUT') AND (e % 35 = 4 OR e % 101 = 7) THEN 1
                  ELSE 0 END AS BIGINT) AS isFraud,
        CAST(CASE WHEN t = 'TRANSFER' AND amt > 200000 AND e % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS isFlaggedFraud
    FROM ev2
)"""


# Literals, so that a changed cut-off, label, type list or name on the Spark side shows.
AMOUNT_BAND_CASE = (
    "CASE WHEN amount <= 1000 THEN '0-1K' WHEN amount <= 10000 THEN '1K-10K' WHEN amount <= 50000 THEN '10K-50K' "
    "WHEN amount <= 100000 THEN '50K-100K' WHEN amount <= 200000 THEN '100K-200K' ELSE '200K+' END"
)
BALANCE_BAND_CASE = (
    "CASE WHEN oldbalanceOrg = 0 THEN '0' WHEN oldbalanceOrg <= 1000 THEN '1-1K' WHEN oldbalanceOrg <= 10000 THEN '1K-10K' "
    "WHEN oldbalanceOrg <= 100000 THEN '10K-100K' ELSE '100K+' END"
)
AMOUNT_BAND_RANK = (
    "CASE amount_band WHEN '0-1K' THEN 1 WHEN '1K-10K' THEN 2 WHEN '10K-50K' THEN 3 WHEN '50K-100K' THEN 4 "
    "WHEN '100K-200K' THEN 5 WHEN '200K+' THEN 6 END"
)
RULE_A = "amount > 200000"
RULE_B = "type IN ('TRANSFER', 'CASH_OUT') AND amount > 200000"
RULE_C = "type IN ('TRANSFER') AND amount > 100000"
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
LARGE_AMOUNT = 200000


SEGMENTED_CTE = f"""
seg AS (
    SELECT *,
        {AMOUNT_BAND_CASE} AS amount_band,
        {BALANCE_BAND_CASE} AS origin_balance_band,
        CASE WHEN oldbalanceOrg = 0 THEN 1 ELSE 0 END AS origin_balance_zero_flag
    FROM tx
)"""


def money(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def rate(num: str, den: str, digits: int) -> str:
    return f"ROUND(CAST({num} AS DOUBLE) * 100.0 / NULLIF(CAST({den} AS DOUBLE), 0), {digits})"


def q(body: str, *ctes: str, segmented: bool = False) -> str:
    """Wrap a query body with the fixture CTE (and the segmented view if needed)."""
    parts = [FIXTURE_CTE]
    if segmented:
        parts.append(SEGMENTED_CTE)
    parts.extend(ctes)
    return "WITH " + ",".join(parts) + "\n" + body
