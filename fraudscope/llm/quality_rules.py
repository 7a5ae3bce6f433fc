"""Host-level quality rules.

Each document gets its base figures and a few soft rules. Failures of each soft
rule, and of any, are summed by host, and each host's failure rates are shrunk toward
the corpus by beta priors that are fitted to all hosts (method of moments), so
that a host with few documents is judged by the corpus and one with many by its
own record. The verdicts are joined back to the documents:

* a rule is in force on a host unless the host's odds of failing it are less than
  ``LENIENT`` times the corpus's odds; a document that fails a rule in force goes, and on a
  host with so clean a record the failure is taken as an accident and the document stays;
* a host whose shrunken rate of failing any rule reaches ``HOST_LIMIT`` is bad: every
  rule is in force there.

A document that fails no rule always stays. Failing the base rule rejects on any host.

Everything is DataFrame expressions: one scan of the texts, then small rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudscope.llm.common import SPACE, let, materialise, table, words

#: Windows of this many words count as repeats.
WINDOW = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Host verdict: the shrunken failure rate from which a host is bad.
HOST_LIMIT = 0.5
#: A rule is in force from this ratio of a host's odds of failing it to the corpus's odds.
LENIENT = 0.5
#: Weight of the prior, in documents, where hosts do not differ more than chance makes them.
MAX_PRIOR_DOCS = 1000.0

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class SoftRule:
    """``100 * figure > percent * base`` fails, written in whole numbers."""

    figure: str
    percent: int
    base: str


#: A document's soft rules: symbols by characters, repeated words, and words that are very long on average.
SOFT_RULES = (
    SoftRule("n_symbols", 10, "word_chars"),
    SoftRule("n_repeat_words", 30, "n_words"),
    SoftRule("n_dup_lines", 10, "n_words"),
    SoftRule("word_chars", 1200, "n_words"),
)


def _repeat_words(w: Column) -> Column:
    """Words (positions) inside windows of three words that occur twice or more.

    The windows' 64-bit hashes are sorted with their positions; equal
    neighbours are repeats. Their sorted positions p1 < p2 < ... cover
    min(3, p(j+1) - p(j)) words each, the last one three. (Two different windows
    of one text share a hash with a chance of n^2 / 2^65.)
    """
    n = F.size(w)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))

    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i"))

    def positions(grams: Column) -> Column:
        def same(g: Column, k: Column) -> Column:
            return F.coalesce(F.get(grams, k)["h"] == g["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(grams, lambda g, k: same(g, k - 1) | same(g, k + 1)), lambda g: g["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(F.sort_array(F.transform(starts, window)), lambda grams: let(positions(grams), covered))


def base_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (no text) with ``FIGURES`` and ``base_failed``; a NULL text has no words and fails."""
    raw = F.col(f"`{text_col}`")
    text = F.coalesce(raw, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    by_words = let(words(raw), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
    dup_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    figures = F.struct(
        by_words.alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        dup_lines.alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # one generated row: the figures are computed once, whatever refers to them above
    out = docs.select(*rest, F.inline(F.array(figures)))
    out = out.withColumn("n_words", F.col("w.n")).withColumn("n_repeat_words", F.col("w.r"))
    return out.select(*rest, *FIGURES, failed.alias("base_failed"))


_FAILS = [f"fails_{r.figure}" for r in SOFT_RULES]


def _with_failures(figures: DataFrame) -> DataFrame:
    """``figures`` with a column for each soft rule, whether it fails, and ``soft_failed``."""
    failed = [(100 * F.col(r.figure) > r.percent * F.col(r.base)).alias(c) for r, c in zip(SOFT_RULES, _FAILS)]
    out = figures.select("*", *failed)
    some = F.lit(False)
    for c in _FAILS:
        some = some | F.col(c)
    return out.withColumn("soft_failed", some)


def _prior_weight(between: float, m: float) -> float:
    """Documents that the prior weighs, from the hosts' own variance and the corpus rate."""
    return min(MAX_PRIOR_DOCS, max(1.0, m * (1 - m) / between - 1)) if between > 0 else MAX_PRIOR_DOCS


def host_verdicts(figures: DataFrame) -> DataFrame:
    """(host, n_docs, failure_rate, host_bad, force_0, force_1, ...) from ``host``, ``soft_failed`` and the rules' failures.

    With rates r_h of n_h documents, overall rate m: the weighted variance of
    r_h less its binomial part m(1-m)/n_h is the hosts' own variance v, and the
    prior weighs m(1-m)/v - 1 documents (between 1 and ``MAX_PRIOR_DOCS``); each rule has its own.
    """
    kinds = ["soft_failed", *_FAILS]
    counts = [F.sum(F.col(c).cast("long")).alias(f"k{i}") for i, c in enumerate(kinds)]
    hosts = materialise(figures.groupBy("host").agg(F.count("*").alias("n_docs"), *counts), "hosts")
    # two rows of sums, whatever the number of hosts
    docs, n_hosts, *fails = hosts.agg(F.sum("n_docs"), F.count("*"), *[F.sum(f"k{i}") for i in range(len(kinds))]).first()
    means = [(k or 0) / docs if docs else 0.0 for k in fails]
    off = [F.sum(F.col("n_docs") * F.pow(F.col(f"k{i}") / F.col("n_docs") - F.lit(m), 2.0)) for i, m in enumerate(means)]
    spread = hosts.agg(*off).first() if docs else [0.0] * len(kinds)
    rates = []
    for i, m in enumerate(means):
        weight = _prior_weight((spread[i] - n_hosts * m * (1 - m)) / docs, m) if docs else MAX_PRIOR_DOCS
        rates.append((F.col(f"k{i}") + F.lit(m * weight)) / (F.col("n_docs") + F.lit(weight)))
    out = hosts.select("host", "n_docs", *[r.alias(f"r{i}") for i, r in enumerate(rates)])
    force = [(F.col(f"r{i + 1}") * F.lit(1 - m) >= F.lit(LENIENT * m) * (1 - F.col(f"r{i + 1}"))).alias(f"force_{i}") for i, m in enumerate(means[1:])]
    return out.select("host", "n_docs", F.col("r0").alias("failure_rate"), (F.col("r0") >= HOST_LIMIT).alias("host_bad"), *force)


def _rejected() -> Column:
    """Whether a document fails a rule that its host's verdict puts in force."""
    hit = F.col("soft_failed") & F.col("host_bad")
    for i, c in enumerate(_FAILS):
        hit = hit | (F.col(c) & F.col(f"force_{i}"))
    return hit


def quality_verdicts(docs: DataFrame, id_cols: list[str], host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``id_cols``, the base figures, ``base_failed``, host evidence and ``kept``; one row per row of ``docs``.

    A NULL host and an empty one are the same host. A NULL or empty text has no
    words and fails the base rule. Repeated rows each count and each get a row. A very
    long text is one row's work; an empty table gives no rows.
    """
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(id_cols)]
    host = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host")
    figures = base_figures(docs.select(*keys, host, F.col(f"`{text_col}`").alias("text")))
    figures = materialise(_with_failures(figures), "figures")
    judged = figures.join(host_verdicts(figures).drop("n_docs"), "host")
    return judged.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(id_cols)],
        *FIGURES,
        "base_failed",
        "soft_failed",
        F.col("failure_rate").alias("host_failure_rate"),
        "host_bad",
        (~F.col("base_failed") & ~_rejected()).alias("kept"),
    )


def keep_good(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_verdicts` keeps, with their columns.

    NULLs, empty tables, repeated rows and columns with clashing names are as there: every
    column of a kept row comes back as it was. The figures are worked out once: the rows go to a
    scratch table with their marks (those that fail the base rule without their columns), which is
    read for the hosts' records and for the verdict. Only rows that fail a soft rule meet
    the verdicts, so the texts of the others are never shuffled.
    """
    host = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = _with_failures(base_figures(docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"), host.alias("host"))))
    passed = F.when(~F.col("base_failed"), F.col("row")).alias("row")
    marked = materialise(marked.select(passed, "host", "base_failed", "soft_failed", *_FAILS), "marked")
    verdicts = materialise(host_verdicts(marked), "host-verdicts")
    good = marked.filter("not base_failed")
    judged = good.filter("soft_failed").join(verdicts, "host").filter(~_rejected())
    return good.filter("not soft_failed").select("row.*").unionByName(judged.select("row.*"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), ["doc_id"]).drop("host_failure_rate")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
f AS (
  SELECT d.rid, doc_id, host, len(w.w) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN p USING (rid)),
s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * word_chars AS s1, 100 * n_repeat_words > 30 * n_words AS s2,
    100 * n_dup_lines > 10 * n_words AS s3, 100 * word_chars > 1200 * n_words AS s4, s1 OR s2 OR s3 OR s4 AS s0
  FROM f),
h AS (
  SELECT host, unnest([0, 1, 2, 3, 4]) AS rule, count(*)::DOUBLE AS n,
    unnest([sum(s0::INT), sum(s1::INT), sum(s2::INT), sum(s3::INT), sum(s4::INT)])::DOUBLE AS k
  FROM s GROUP BY host),
m AS (SELECT rule, sum(k) / sum(n) AS m, sum(n) AS n, count(*) AS hosts FROM h GROUP BY rule),
b AS (
  SELECT rule, any_value(m.m) AS m, (sum(h.n * pow(h.k / h.n - m.m, 2)) - any_value(m.hosts * m.m * (1 - m.m))) / any_value(m.n) AS v
  FROM h JOIN m USING (rule) GROUP BY rule),
q AS (SELECT rule, m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS a FROM b),
x AS (SELECT host, rule, m, (k + m * a) / (n + a) AS rate FROM h JOIN q USING (rule)),
y AS (
  SELECT host, max(rate) FILTER (rule = 0) >= 0.5 AS host_bad, bool_or(rate * (1 - m) >= 0.5 * m * (1 - rate)) FILTER (rule = 1) AS f1,
    bool_or(rate * (1 - m) >= 0.5 * m * (1 - rate)) FILTER (rule = 2) AS f2, bool_or(rate * (1 - m) >= 0.5 * m * (1 - rate)) FILTER (rule = 3) AS f3,
    bool_or(rate * (1 - m) >= 0.5 * m * (1 - rate)) FILTER (rule = 4) AS f4
  FROM x GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, s0 AS soft_failed, host_bad,
  NOT base_failed AND NOT ((host_bad AND s0) OR (s1 AND f1) OR (s2 AND f2) OR (s3 AND f3) OR (s4 AND f4)) AS kept
FROM s JOIN y USING (host)
"""
