"""Oracle SQL per registered key (DuckDB dialect)."""

from __future__ import annotations

from fraudscope.plans.oracle_sql import (
    ALL_ASC,
    AMOUNT_BAND_RANK,
    COLS,
    LARGE_AMOUNT,
    RULE_A,
    RULE_B,
    RULE_C,
    RULE_NAMES_ANALYSIS,
    RULE_NAMES_DASHBOARD,
    all_asc_except,
    money,
    q,
    rate,
)

_TOTALS = f"""
totals AS (
    SELECT COUNT(*) AS total_transactions,
        {money('amount')} AS total_value,
        CAST(SUM(CASE WHEN isFraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS total_fraud_count,
        {money("CASE WHEN isFraud = 1 THEN amount ELSE 0 END")} AS total_fraud_value,
        CAST(SUM(CASE WHEN isFraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS total_legit_count,
        {money("CASE WHEN isFraud = 0 THEN amount ELSE 0 END")} AS total_legit_value
    FROM tx
)"""


def _flagged(name: str, where: str) -> str:
    return f"""
    SELECT '{name}' AS threshold_name,
        COUNT(*) AS flagged_transactions,
        {money('amount')} AS flagged_value,
        CAST(SUM(CASE WHEN isFraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fraud_captured_count,
        {money("CASE WHEN isFraud = 1 THEN amount ELSE 0 END")} AS fraud_captured_value,
        CAST(SUM(CASE WHEN isFraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS legit_affected_count,
        {money("CASE WHEN isFraud = 0 THEN amount ELSE 0 END")} AS legit_affected_value
    FROM tx WHERE {where}"""


_RULE_WHERE = (RULE_A, RULE_B, RULE_C)


def _compare(names: tuple[str, ...], wheres: tuple[str, ...]) -> str:
    flagged = "\n    UNION ALL".join(_flagged(n, w) for n, w in zip(names, wheres))
    return q(_COMPARED, _TOTALS, f"\nrules AS ({flagged}\n)")


_COMPARED = f"""
SELECT r.threshold_name, r.flagged_transactions, r.flagged_value,
    r.fraud_captured_count, r.fraud_captured_value,
    {rate('r.fraud_captured_count', 't.total_fraud_count', 2)} AS fraud_count_capture_pct,
    {rate('r.fraud_captured_value', 't.total_fraud_value', 2)} AS fraud_value_capture_pct,
    r.legit_affected_count, r.legit_affected_value,
    {rate('r.legit_affected_count', 't.total_legit_count', 2)} AS legit_count_affected_pct,
    {rate('r.legit_affected_value', 't.total_legit_value', 2)} AS legit_value_affected_pct,
    {rate('r.flagged_transactions', 't.total_transactions', 2)} AS total_txns_flagged_pct,
    {rate('r.flagged_value', 't.total_value', 2)} AS total_value_flagged_pct
FROM rules r, totals t
ORDER BY r.threshold_name"""


def _detail(where: str) -> str:
    return q(
        f"""
SELECT type,
    COUNT(*) AS flagged_transactions,
    CAST(SUM(CASE WHEN isFraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fraud_captured_count,
    {money("CASE WHEN isFraud = 1 THEN amount ELSE 0 END")} AS fraud_captured_value,
    CAST(SUM(CASE WHEN isFraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS legit_affected_count
FROM tx WHERE {where}
GROUP BY type
ORDER BY fraud_captured_count DESC NULLS LAST, flagged_transactions DESC NULLS LAST, type NULLS LAST"""
    )


_SWEEP = "SELECT 'TRANSFER/CASH_OUT > ' || k || 'K' AS threshold_name, k * 1000 AS cut FROM range(3, 903, 3) AS r(k)"
_SWEEP_MANY = "SELECT 'TRANSFER/CASH_OUT > ' || (45 * k) AS threshold_name, 45 * k AS cut FROM range(1, 20001) AS r(k)"


def _sweep(cuts: str) -> str:
    """Cut-offs as a table; a cut-off that flags nothing has count 0 and NULL sums."""
    rules = f"""
cuts AS ({cuts}),
hit AS (SELECT *, 1 AS hit FROM tx WHERE type IN ('TRANSFER', 'CASH_OUT')),
rules AS (
    SELECT threshold_name, COUNT(hit) AS flagged_transactions,
        {money('amount')} AS flagged_value,
        CAST(SUM(CASE WHEN hit IS NULL THEN NULL WHEN isFraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fraud_captured_count,
        {money("CASE WHEN hit IS NULL THEN NULL WHEN isFraud = 1 THEN amount ELSE 0 END")} AS fraud_captured_value,
        CAST(SUM(CASE WHEN hit IS NULL THEN NULL WHEN isFraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS legit_affected_count,
        {money("CASE WHEN hit IS NULL THEN NULL WHEN isFraud = 0 THEN amount ELSE 0 END")} AS legit_affected_value
    FROM cuts LEFT JOIN hit ON amount > cut GROUP BY threshold_name)"""
    return q(_COMPARED, _TOTALS, rules)


ORACLES: dict[str, str] = {
    "th_base_totals": q("SELECT * FROM totals", _TOTALS),
    "th_compare_ab": _compare(RULE_NAMES_ANALYSIS[:2], _RULE_WHERE[:2]),
    "th_detail_a": _detail(_RULE_WHERE[0]),
    "th_detail_b": _detail(_RULE_WHERE[1]),
    "th_compare_c": _compare(RULE_NAMES_ANALYSIS[2:], _RULE_WHERE[2:]),
    "th_sweep": _sweep(_SWEEP),
    "th_sweep_many": _sweep(_SWEEP_MANY),
    "th_compare_abc": _compare(RULE_NAMES_DASHBOARD, _RULE_WHERE),
    "review_queue": q(
        f"""
SELECT {COLS},
    COALESCE({RULE_B}, false) AS primary_flag,
    COALESCE({RULE_C}, false) AS watchlist_flag,
    CASE WHEN {RULE_B} THEN 'primary'
         WHEN {RULE_C} THEN 'watchlist'
         ELSE 'none' END AS review_queue
FROM tx"""
    ),
}


# ------------------------------------------------------------ sources ------

ORACLES["scan_transactions"] = q(f"SELECT {COLS} FROM tx")
ORACLES["preview"] = q(f"SELECT {COLS} FROM tx ORDER BY {ALL_ASC} LIMIT 10")
ORACLES["segmented_view"] = q(f"SELECT * FROM seg", segmented=True)

# -------------------------------------------------------- data quality -----

_NOT_MERCHANT = "NOT (nameDest LIKE 'M%')"
_ORIG_MISMATCH = "ROUND(oldbalanceOrg - amount, 2) <> ROUND(newbalanceOrig, 2)"
_DEST_MISMATCH = f"{_NOT_MERCHANT} AND ROUND(oldbalanceDest + amount, 2) <> ROUND(newbalanceDest, 2)"


def _cnt(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


_COL_LIST = [c.strip() for c in COLS.split(",")]
_MISSING = ",\n    ".join(f"{_cnt(c + ' IS NULL')} AS missing_{c}" for c in _COL_LIST)
_NEG = ",\n    ".join(
    f"{_cnt(c + ' < 0')} AS neg_{c}" for c in ("oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")
)
_AVG = "ROUND(CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(CAST(COUNT(amount) AS DOUBLE), 0), 4)"
_GROUPS = f"\ngroups AS (SELECT {COLS}, COUNT(*) AS duplicate_count FROM tx GROUP BY ALL)"
_UNFLAGGED = f"type = 'TRANSFER' AND amount > {LARGE_AMOUNT} AND isFlaggedFraud = 0"

ORACLES.update(
    {
        "dq_missing_values": q(f"SELECT\n    {_MISSING}\nFROM tx"),
        "dq_merchant_missing": q(
            f"""SELECT COUNT(*) AS merchant_rows,
    {_cnt('oldbalanceDest IS NULL')} AS missing_oldbalanceDest,
    {_cnt('newbalanceDest IS NULL')} AS missing_newbalanceDest
FROM tx WHERE nameDest LIKE 'M%'"""
        ),
        "dq_duplicate_summary": q(
            """SELECT CAST(COALESCE(SUM(duplicate_count), 0) AS BIGINT) AS total_rows,
    COUNT(*) AS distinct_rows,
    CAST(COALESCE(SUM(duplicate_count), 0) AS BIGINT) - COUNT(*) AS duplicate_rows
FROM groups""",
            _GROUPS,
        ),
        "dq_duplicate_groups": q(
            f"SELECT * FROM groups WHERE duplicate_count > 1 ORDER BY duplicate_count DESC, {ALL_ASC}", _GROUPS
        ),
        "dq_invalid_amount_counts": q(
            f"SELECT {_cnt('amount < 0')} AS negative_amounts, {_cnt('amount = 0')} AS zero_amounts FROM tx"
        ),
        "dq_invalid_amount_rows": q(f"SELECT {COLS} FROM tx WHERE amount <= 0 ORDER BY amount NULLS LAST"),
        "dq_amount_stats": q(
            f"SELECT MIN(amount) AS min_amount, MAX(amount) AS max_amount, {_AVG} AS avg_amount FROM tx"
        ),
        "dq_top_amounts": q(
            f"SELECT {COLS} FROM tx ORDER BY amount DESC NULLS LAST, {all_asc_except('amount')} LIMIT 20"
        ),
        "dq_origin_balance_mismatch_count": q(
            f"SELECT COUNT(*) AS inconsistent_origin_balance FROM tx WHERE {_ORIG_MISMATCH}"
        ),
        "dq_origin_balance_mismatch_rows": q(
            f"SELECT {COLS} FROM tx WHERE {_ORIG_MISMATCH} ORDER BY {ALL_ASC} LIMIT 50"
        ),
        "dq_dest_balance_mismatch_count": q(
            f"SELECT COUNT(*) AS inconsistent_dest_balance FROM tx WHERE {_DEST_MISMATCH}"
        ),
        "dq_dest_balance_mismatch_rows": q(
            f"SELECT {COLS} FROM tx WHERE {_DEST_MISMATCH} ORDER BY {ALL_ASC} LIMIT 50"
        ),
        "dq_negative_balances": q(f"SELECT\n    {_NEG}\nFROM tx"),
        "dq_fraud_distribution": q(
            f"""SELECT isFraud, COUNT(*) AS transactions,
    {rate('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 4)} AS pct_of_total
FROM tx GROUP BY isFraud"""
        ),
        "dq_type_by_label": q(
            "SELECT type, isFraud, COUNT(*) AS transactions FROM tx GROUP BY type, isFraud "
            "ORDER BY type NULLS LAST, isFraud NULLS LAST"
        ),
        "dq_fraud_rate_by_type": q(
            f"""SELECT type, COUNT(*) AS total_txns, CAST(SUM(isFraud) AS BIGINT) AS fraud_txns,
    {rate('SUM(isFraud)', 'COUNT(*)', 4)} AS fraud_rate_pct
FROM tx GROUP BY type"""
        ),
        "dq_amount_outliers": q(
            f"""SELECT {COLS} FROM tx
WHERE amount > (SELECT AVG(amount) + 3 * STDDEV_SAMP(amount) FROM tx)
ORDER BY amount DESC NULLS LAST"""
        ),
        "dq_flagged_rows": q(f"SELECT {COLS} FROM tx WHERE isFlaggedFraud = 1"),
        "dq_flagged_stats": q(
            "SELECT COUNT(*) AS flagged_rows, MIN(amount) AS min_flagged_amount, "
            "MAX(amount) AS max_flagged_amount FROM tx WHERE isFlaggedFraud = 1"
        ),
        "dq_flagged_by_type": q("SELECT type, COUNT(*) AS flagged_count FROM tx WHERE isFlaggedFraud = 1 GROUP BY type"),
        "dq_unflagged_large_transfers": q(f"SELECT {COLS} FROM tx WHERE {_UNFLAGGED}"),
        "dq_unflagged_fraud_transfers": q(f"SELECT {COLS} FROM tx WHERE {_UNFLAGGED} AND isFraud = 1"),
        "dq_zero_origin_balance": q(
            f"""SELECT {COLS} FROM tx WHERE amount > 0 AND oldbalanceOrg = 0
ORDER BY amount DESC NULLS LAST, {all_asc_except('amount')} LIMIT 50"""
        ),
        "dq_zero_dest_balance": q(
            f"""SELECT {COLS} FROM tx WHERE amount > 0 AND oldbalanceDest = 0 AND {_NOT_MERCHANT}
ORDER BY {ALL_ASC} LIMIT 50"""
        ),
        "dq_report": q(
            f"""SELECT COUNT(*) AS total_rows,
    {_MISSING},
    {_cnt("nameDest LIKE 'M%'")} AS merchant_rows,
    CAST(SUM(CASE WHEN nameDest LIKE 'M%' THEN CAST(oldbalanceDest IS NULL AS INTEGER) END) AS BIGINT)
        AS merchant_missing_oldbalanceDest,
    CAST(SUM(CASE WHEN nameDest LIKE 'M%' THEN CAST(newbalanceDest IS NULL AS INTEGER) END) AS BIGINT)
        AS merchant_missing_newbalanceDest,
    {_cnt('amount < 0')} AS negative_amounts,
    {_cnt('amount = 0')} AS zero_amounts,
    MIN(amount) AS min_amount, MAX(amount) AS max_amount, {_AVG} AS avg_amount,
    {_cnt('isnan(amount) OR isinf(amount)')} AS not_finite_amount,
    {_cnt('round(amount, 2) <> amount')} AS finer_amount,
    COUNT(*) FILTER (WHERE {_ORIG_MISMATCH}) AS inconsistent_origin_balance,
    COUNT(*) FILTER (WHERE {_DEST_MISMATCH}) AS inconsistent_dest_balance,
    {_NEG},
    COUNT(*) FILTER (WHERE isFlaggedFraud = 1) AS flagged_rows,
    MIN(amount) FILTER (WHERE isFlaggedFraud = 1) AS min_flagged_amount,
    MAX(amount) FILTER (WHERE isFlaggedFraud = 1) AS max_flagged_amount
FROM tx"""
        ),
    }
)

# ---------------------------------------------------------------- KPIs -----

_FRAUD_VALUE = money("CASE WHEN isFraud = 1 THEN amount ELSE 0 END")
_SIX = f"""COUNT(*) AS total_transactions,
    {money('amount')} AS total_value,
    CAST(SUM(isFraud) AS BIGINT) AS fraud_count,
    {_FRAUD_VALUE} AS fraud_value,
    {rate('SUM(isFraud)', 'COUNT(*)', 4)} AS fraud_rate_pct"""

ORACLES.update(
    {
        "kpi_by_type": q(f"SELECT type, {_SIX} FROM tx GROUP BY type ORDER BY fraud_rate_pct DESC NULLS LAST"),
        "kpi_overall": q(f"SELECT {_SIX} FROM tx"),
        "kpi_executive_summary": q(
            f"""SELECT b.total_transactions, b.total_transaction_value, b.total_fraud_count, b.total_fraud_value,
    {rate('b.total_fraud_count', 'b.total_transactions', 4)} AS fraud_rate_pct,
    {rate('b.total_fraud_value', 'b.total_transaction_value', 4)} AS fraud_value_rate_pct,
    t.top_risk_transaction_type
FROM b, t""",
            f"""
b AS (SELECT COUNT(*) AS total_transactions, {money('amount')} AS total_transaction_value,
        {_cnt('isFraud = 1')} AS total_fraud_count, {_FRAUD_VALUE} AS total_fraud_value FROM tx)""",
            f"""
t AS (SELECT type AS top_risk_transaction_type FROM tx GROUP BY type
      ORDER BY {rate('SUM(isFraud)', 'COUNT(*)', 4)} DESC NULLS LAST,
               SUM(CAST(CASE WHEN isFraud = 1 THEN amount ELSE 0 END AS DECIMAL(18,2))) DESC NULLS LAST,
               type ASC NULLS LAST
      LIMIT 1)""",
        ),
        "kpi_trend_by_step": q(
            f"""SELECT step, COUNT(*) AS total_transactions, {money('amount')} AS total_transaction_value,
    {_cnt('isFraud = 1')} AS fraud_count, {_FRAUD_VALUE} AS fraud_value,
    {rate(_cnt('isFraud = 1'), 'COUNT(*)', 4)} AS fraud_rate_pct
FROM tx GROUP BY step ORDER BY step"""
        ),
    }
)

# ------------------------------------------------------- segmentation ------


def _seg(keys: str, having: str = "", order: str = "", limit: str = "", cols: str = _SIX) -> str:
    return q(
        f"SELECT {keys}, {cols} FROM seg GROUP BY {keys} {having} {order} {limit}",
        segmented=True,
    )


_RISK = "ORDER BY fraud_rate_pct DESC NULLS LAST, fraud_value DESC NULLS LAST"
_NO_VALUE = f"""COUNT(*) AS total_transactions,
    CAST(SUM(isFraud) AS BIGINT) AS fraud_count,
    {_FRAUD_VALUE} AS fraud_value,
    {rate('SUM(isFraud)', 'COUNT(*)', 4)} AS fraud_rate_pct"""

ORACLES.update(
    {
        "seg_by_type": _seg("type", order=_RISK),
        "seg_by_amount_band": _seg("amount_band"),
        "seg_by_origin_balance_band": _seg("origin_balance_band"),
        "seg_by_zero_balance_flag": _seg(
            "origin_balance_zero_flag", order="ORDER BY origin_balance_zero_flag DESC", cols=_NO_VALUE
        ),
        "seg_type_amount": _seg("type, amount_band", having="HAVING COUNT(*) >= 100"),
        "seg_type_balance": _seg("type, origin_balance_band", having="HAVING COUNT(*) >= 100"),
        "seg_type_amount_balance": _seg(
            "type, amount_band, origin_balance_band", having="HAVING COUNT(*) >= 100"
        ),
        "seg_fraud_share": q(
            f"""SELECT type, amount_band, COUNT(*) AS total_transactions, CAST(SUM(isFraud) AS BIGINT) AS fraud_count,
    {rate('SUM(isFraud)', 'SUM(SUM(isFraud)) OVER ()', 4)} AS share_of_total_fraud_pct,
    {rate('SUM(isFraud)', 'COUNT(*)', 4)} AS fraud_rate_pct
FROM seg GROUP BY type, amount_band HAVING COUNT(*) >= 100""",
            segmented=True,
        ),
        "seg_top_risk": _seg(
            "type, amount_band, origin_balance_band",
            having="HAVING COUNT(*) >= 100 AND SUM(isFraud) > 0",
            order=_RISK + ", type NULLS LAST, amount_band NULLS LAST, origin_balance_band NULLS LAST",
            limit="LIMIT 20",
            cols=_NO_VALUE,
        ),
    }
)


# ---------------------------------------------------------- monitoring -----


def _per(ph: int, extra_keys: str = "", measures: str = "") -> str:
    keys = "period" + (f", {extra_keys}" if extra_keys else "")
    return f"""
per AS (
    SELECT CAST(floor((step - 1) / {ph}) AS BIGINT) AS period{', ' + extra_keys if extra_keys else ''},
        COUNT(*) AS n,
        SUM(CAST(amount AS DECIMAL(18,2))) AS v,
        COUNT(*) FILTER (WHERE isFraud = 1) AS fn,
        SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE isFraud = 1) AS fv{measures}
    FROM {'seg' if 'amount_band' in extra_keys else 'tx'} GROUP BY {keys}
),
periods AS (SELECT UNNEST(generate_series(MIN(period), MAX(period))) AS period FROM per)"""


def _metrics_body(ph: int) -> str:
    return f"""
SELECT p.period, p.period * {ph} + 1 AS period_start_step,
    COALESCE(n, 0) AS total_transactions,
    CAST(COALESCE(v, 0) AS DOUBLE) AS total_value,
    COALESCE(fn, 0) AS fraud_count,
    CAST(COALESCE(fv, 0) AS DOUBLE) AS fraud_value,
    {rate('COALESCE(fn, 0)', 'COALESCE(n, 0)', 4)} AS fraud_rate_pct
FROM periods p LEFT JOIN per USING (period)"""


def _rate_by_type_body(ph: int) -> str:
    return f"""
SELECT s.period, s.period * {ph} + 1 AS period_start_step, s.type,
    COALESCE(n, 0) AS total_transactions,
    COALESCE(fn, 0) AS fraud_count,
    CAST(COALESCE(fv, 0) AS DOUBLE) AS fraud_value,
    {rate('COALESCE(fn, 0)', 'COALESCE(n, 0)', 4)} AS fraud_rate_pct
FROM (SELECT DISTINCT per.type, periods.period FROM per, periods) s
LEFT JOIN per ON per.period = s.period AND per.type IS NOT DISTINCT FROM s.type"""


_RULE_B = f"COALESCE({RULE_B}, false)"
_RULE_C = f"COALESCE({RULE_C}, false)"
_THRESHOLD_MEASURES = f""",
        COUNT(*) FILTER (WHERE isFraud = 0) AS ln,
        COUNT(*) FILTER (WHERE {_RULE_B}) AS an,
        SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE {_RULE_B}) AS av,
        COUNT(*) FILTER (WHERE {_RULE_C} AND NOT {_RULE_B}) AS wn,
        COUNT(*) FILTER (WHERE {_RULE_B} AND isFraud = 1) AS cn,
        SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE {_RULE_B} AND isFraud = 1) AS cv,
        COUNT(*) FILTER (WHERE {_RULE_B} AND isFraud = 0) AS lan,
        SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE {_RULE_B} AND isFraud = 0) AS lav"""


def _threshold_body(ph: int) -> str:
    return f"""
SELECT p.period, p.period * {ph} + 1 AS period_start_step,
    COALESCE(n, 0) AS total_transactions,
    COALESCE(an, 0) AS above_threshold_count,
    CAST(COALESCE(av, 0) AS DOUBLE) AS above_threshold_value,
    COALESCE(an, 0) AS review_queue_volume,
    COALESCE(wn, 0) AS watchlist_volume,
    COALESCE(cn, 0) AS fraud_captured_count,
    CAST(COALESCE(cv, 0) AS DOUBLE) AS fraud_captured_value,
    {rate('COALESCE(cn, 0)', 'COALESCE(fn, 0)', 2)} AS fraud_count_capture_pct,
    {rate('CAST(COALESCE(cv, 0) AS DOUBLE)', 'CAST(COALESCE(fv, 0) AS DOUBLE)', 2)} AS fraud_value_capture_pct,
    COALESCE(lan, 0) AS legit_affected_count,
    CAST(COALESCE(lav, 0) AS DOUBLE) AS legit_affected_value,
    {rate('COALESCE(lan, 0)', 'COALESCE(ln, 0)', 2)} AS legit_count_affected_pct
FROM periods p LEFT JOIN per USING (period)"""


def _metrics(ph: int) -> str:
    return q(_metrics_body(ph), _per(ph))


def _rate_spike(ph: int, closed_only: bool = False) -> str:
    closed = f"WHERE (period + 1) * {ph} <= (SELECT MAX(step) FROM tx) - 1 - 24" if closed_only else ""
    return q(
        f"""
SELECT period, fraud_rate_pct,
    CASE WHEN c = 4 THEN ROUND(CAST(s AS DOUBLE) / 40000.0, 6) END AS baseline_rate_pct,
    COALESCE(c = 4 AND r * 400 > s * 120, false) AS alert
FROM (
    SELECT period, fraud_rate_pct, r,
        SUM(r) OVER w AS s, COUNT(r) OVER w AS c
    FROM (SELECT *, CAST(ROUND(fraud_rate_pct * 10000) AS BIGINT) AS r FROM m)
    WINDOW w AS (ORDER BY period RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)
) {closed}""",
        _per(ph),
        f"\nm AS ({_metrics_body(ph)})",
    )


def _type_spike(ph: int, txn_type: str) -> str:
    return q(
        f"""
SELECT period, type, fraud_count, fraud_rate_pct,
    CASE WHEN cc = 4 THEN CAST(cs AS DOUBLE) / 4.0 END AS baseline_fraud_count,
    CASE WHEN rc = 4 THEN ROUND(CAST(rs AS DOUBLE) / 40000.0, 6) END AS baseline_rate_pct,
    COALESCE(rc = 4 AND r * 400 > rs * 120, false) OR COALESCE(cc = 4 AND fraud_count * 400 > cs * 120, false) AS alert
FROM (
    SELECT *, SUM(r) OVER w AS rs, COUNT(r) OVER w AS rc,
        SUM(fraud_count) OVER w AS cs, COUNT(fraud_count) OVER w AS cc
    FROM (SELECT *, CAST(ROUND(fraud_rate_pct * 10000) AS BIGINT) AS r FROM m WHERE type = '{txn_type}')
    WINDOW w AS (PARTITION BY type ORDER BY period RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)
)""",
        _per(ph, "type"),
        f"\nm AS ({_rate_by_type_body(ph)})",
    )


def _wow(ph: int, txn_type: str) -> str:
    return q(
        f"""
SELECT period, type, fraud_count, fraud_value, prev_fraud_count,
    CAST(pv AS DOUBLE) AS prev_fraud_value,
    COALESCE(fraud_count * 100 > prev_fraud_count * 120, false)
        OR COALESCE(CAST(fraud_value AS DECIMAL(38,2)) * 100 > pv * 120, false) AS alert
FROM (
    SELECT *, LAG(fraud_count) OVER w AS prev_fraud_count,
        LAG(CAST(fraud_value AS DECIMAL(38,2))) OVER w AS pv
    FROM m WHERE type = '{txn_type}'
    WINDOW w AS (PARTITION BY type ORDER BY period)
)""",
        _per(ph, "type"),
        f"\nm AS ({_rate_by_type_body(ph)})",
    )


def _surge(ph: int) -> str:
    return q(
        """
SELECT period, above_threshold_count,
    CASE WHEN c = 4 THEN CAST(s AS DOUBLE) / 4.0 END AS baseline_count,
    COALESCE(c = 4 AND above_threshold_count * 400 > s * 120, false) AS alert
FROM (
    SELECT *, SUM(above_threshold_count) OVER w AS s, COUNT(above_threshold_count) OVER w AS c
    FROM m WINDOW w AS (ORDER BY period RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)
)""",
        _per(ph, measures=_THRESHOLD_MEASURES),
        f"\nm AS ({_threshold_body(ph)})",
    )


def _concentration(ph: int) -> str:
    rank = AMOUNT_BAND_RANK
    return q(
        f"""
SELECT period, type AS top_type, amount_band AS top_amount_band,
    CAST(sv AS DOUBLE) AS top_fraud_value, CAST(pv AS DOUBLE) AS period_fraud_value,
    {rate('CAST(sv AS DOUBLE)', 'CAST(pv AS DOUBLE)', 2)} AS top_share_pct,
    sv * 100 > pv * 50 AS alert
FROM (
    SELECT *, SUM(sv) OVER (PARTITION BY period) AS pv,
        ROW_NUMBER() OVER (PARTITION BY period ORDER BY sv DESC, type ASC NULLS LAST, {rank}) AS rn
    FROM (
        SELECT CAST(floor((step - 1) / {ph}) AS BIGINT) AS period, type, amount_band,
            COALESCE(SUM(CAST(amount AS DECIMAL(18,2))), 0) AS sv
        FROM seg WHERE isFraud = 1 GROUP BY ALL
    )
)
WHERE rn = 1 AND pv > 0""",
        segmented=True,
    )


def _capacity(ph: int, capacity: int) -> str:
    return q(
        f"""
SELECT period, review_queue_volume, CAST({capacity} AS BIGINT) AS capacity,
    review_queue_volume > {capacity} AS alert
FROM m""",
        _per(ph, measures=_THRESHOLD_MEASURES),
        f"\nm AS ({_threshold_body(ph)})",
    )


_DAY = 24
_WEEK = 168

ORACLES.update(
    {
        "mon_weekly_metrics": _metrics(_WEEK),
        "mon_weekly_rate_by_type": q(_rate_by_type_body(_WEEK), _per(_WEEK, "type")),
        "mon_weekly_threshold": q(_threshold_body(_WEEK), _per(_WEEK, measures=_THRESHOLD_MEASURES)),
        "alert_fraud_rate_spike": _rate_spike(_DAY),
        "alert_transfer_spike": _type_spike(_DAY, "TRANSFER"),
        "alert_cash_out_spike": _wow(_DAY, "CASH_OUT"),
        "alert_review_surge": _surge(_DAY),
        "alert_value_concentration": _concentration(_DAY),
        "alert_capacity_breach": _capacity(_DAY, 50),
        "export_roundtrip": ORACLES["th_compare_abc"],
        "stream_weekly_metrics": q(
            _metrics_body(_WEEK) + f"\nWHERE (p.period + 1) * {_WEEK} <= (SELECT MAX(step) FROM tx) - 1 - 24",
            _per(_WEEK),
        ),
        "stream_review_queue": ORACLES["review_queue"],
        "stream_alerts": _rate_spike(_DAY, closed_only=True),
    }
)

# streamed tables: the rows of the daily periods that the watermark has closed
def _closed(sql: str) -> str:
    return f"SELECT * FROM ({sql}) WHERE (period + 1) * {_DAY} <= (SELECT MAX(step) FROM ({ORACLES['scan_transactions']})) - 1 - 24"


ORACLES.update(
    {
        "stream_rate_by_type": _closed(q(_rate_by_type_body(_DAY), _per(_DAY, "type"))),
        "stream_threshold": _closed(q(_threshold_body(_DAY), _per(_DAY, measures=_THRESHOLD_MEASURES))),
        "stream_transfer_spike": _closed(ORACLES["alert_transfer_spike"]),
        "stream_cash_out_spike": _closed(ORACLES["alert_cash_out_spike"]),
        "stream_review_surge": _closed(ORACLES["alert_review_surge"]),
        "stream_value_concentration": _closed(ORACLES["alert_value_concentration"]),
        "stream_capacity_breach": _closed(ORACLES["alert_capacity_breach"]),
    }
)

# exports hold the tables they were written from
ORACLES.update(
    {
        "scan_csv_roundtrip": ORACLES["scan_transactions"],
        "export_summary_csv": ORACLES["kpi_executive_summary"],
        "export_trend_by_step": ORACLES["kpi_trend_by_step"],
        "export_summary_txt": ORACLES["kpi_executive_summary"],
        "export_fraud_by_type": ORACLES["kpi_by_type"],
        "export_fraud_by_amount_band": ORACLES["seg_by_amount_band"],
        "export_top_risk_segments": ORACLES["seg_top_risk"],
        "export_fraud_by_origin_balance_band": ORACLES["seg_by_origin_balance_band"],
    }
)

# ------------------------------------------- increments, feeds, landings ----

for _name, _same in (
    ("mon_incremental_metrics", "mon_weekly_metrics"),
    ("mon_incremental_rate_by_type", "mon_weekly_rate_by_type"),
    ("mon_incremental_threshold", "mon_weekly_threshold"),
    ("feed_weekly_metrics", "mon_weekly_metrics"),
    ("feed_rate_by_type", "mon_weekly_rate_by_type"),
    ("feed_threshold", "mon_weekly_threshold"),
    ("dq_ledger_summary", "dq_duplicate_summary"),
    ("dq_ledger_groups", "dq_duplicate_groups"),
):
    ORACLES[_name] = ORACLES[_same]

_SPOILT = "(step % 97 = 0 OR step % 89 = 0)"
ORACLES["scan_csv_good"] = q(f"SELECT {COLS} FROM tx WHERE NOT coalesce({_SPOILT}, false)")
ORACLES["scan_csv_rejects"] = q(
    f"""SELECT CASE WHEN step % 97 = 0 THEN 'amount is no double' ELSE 'isFraud is no bigint' END AS reason,
    COUNT(*) AS rejected_rows FROM tx WHERE {_SPOILT} GROUP BY 1"""
)

# exact sums in cents; the deviation from n * squares - sum^2, whole numbers up to the last division
ORACLES["dq_outlier_cutoff"] = q(
    """SELECT n AS amount_rows, ROUND(mean, 4) AS mean_amount, ROUND(dev, 4) AS stddev_amount, ROUND(mean + 3 * dev, 4) AS cutoff
FROM (SELECT n, CAST(s AS DOUBLE) / (100 * n) AS mean,
    SQRT(CAST(n * s2 - s * s AS DOUBLE) / CAST(CAST(n AS HUGEINT) * (n - 1) AS DOUBLE)) / 100 AS dev FROM sums)""",
    """
cents AS (SELECT CAST(ROUND(CAST(amount AS DECIMAL(18,2)) * 100) AS HUGEINT) AS c FROM tx WHERE amount IS NOT NULL),
sums AS (SELECT COUNT(*) AS n, CAST(SUM(c) AS HUGEINT) AS s, CAST(SUM(c * c) AS HUGEINT) AS s2 FROM cents)""",
)
