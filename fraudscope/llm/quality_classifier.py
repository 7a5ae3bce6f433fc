"""Quality classifier with hierarchical empirical Bayes.

1. A logistic regression on a document's own features gives its evidence; it is
   fitted on a bounded sample of the labelled documents.
2. Sites: the documents' evidence (labels where there are any, the classifier's
   probabilities elsewhere) is summed by host and by path within the host. A
   host's rate of good documents is shrunk toward the corpus, a path's toward
   its host, by beta priors whose weights come from how much hosts (paths within
   hosts) really differ; sparse sites stay near their prior.
3. A document's log odds are its own plus those of its path's posterior, taken
   without the document itself, less those of the corpus.

All sums are grouped aggregations over all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudscope.llm.common import materialise, table
from fraudscope.llm.quality_rules import base_figures

#: Labelled documents that the classifier is fitted on, at most (those with the least hashes of their id).
FIT_DOCS = 20_000
#: Weight of a prior, in documents: its bounds.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
#: Probabilities stay this far from 0 and 1.
MARGIN = 1e-6
#: A document with this posterior probability of being good is kept.
KEEP = 0.5

FEATURES = ("log_words", "word_length", "symbol_share", "repeat_share", "dup_line_share", "bar_share", "line_words", "short")


def features(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``, which goes) and the classifier's features; a text without words has zeros and is short."""
    bars = F.length(F.coalesce("text", F.lit(""))) - F.length(F.translate(F.coalesce("text", F.lit("")), "|{};=", ""))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    df = base_figures(docs.withColumn("bars", bars).withColumn("lines", lines))
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    own = {
        "log_words": F.log1p("n_words"),
        "word_length": F.least(F.col("word_chars") / words, F.lit(50.0)),
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("lines"), F.lit(1)),
        "bar_share": F.col("bars") / words,
        "line_words": F.log1p(words / F.greatest(F.col("lines"), F.lit(1))),
        "short": (F.col("n_words") < 50).cast("double"),
    }
    rest = [c for c in docs.columns if c != "text"]
    return df.select(*rest, *[v.cast("double").alias(k) for k, v in own.items()])


def fit(labelled: DataFrame) -> tuple[list[float], float] | None:
    """(coefficients, intercept) of a logistic regression on rows with ``FEATURES`` and ``good``; None without both classes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    sample = materialise(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS), "fit-sample")
    n, good = sample.agg(F.count("*"), F.sum("good")).first()
    if not n or not 0 < good < n:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(sample)
    model = LogisticRegression(featuresCol="x", labelCol="good", regParam=1e-3, maxIter=50).fit(rows)
    return [float(c) for c in model.coefficients], float(model.intercept)


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(MARGIN)), F.lit(1 - MARGIN))
    return F.log(p / (1 - p))


def _prior_weight(sites: DataFrame, mean: Column) -> float:
    """Documents that the prior weighs: by moments, from sites (n, s) around their prior means.

    The weighted variance of the sites' rates less what chance makes of it is
    their own variance v; the weight is m(1-m)/v - 1 at the average.
    """
    m = F.least(F.greatest(mean, F.lit(MARGIN)), F.lit(1 - MARGIN))
    off = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, 2.0))
    # one row, whatever the number of sites
    n, seen, chance, spread = sites.agg(F.sum("n"), off, F.sum(m * (1 - m)), F.sum(F.col("n") * m * (1 - m))).first()
    own = ((seen or 0.0) - (chance or 0.0)) / n if n else 0.0
    if own <= 0:
        return MOST_WEIGHT
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, spread / n / own - 1))


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, float, float]:
    """(host, path, n, s, host_rate), the corpus rate and the paths' prior weight, from rows host, path, value."""
    paths = materialise(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("value").alias("s")), "paths")
    hosts = materialise(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    corpus = s / n if n else 0.5
    weight = _prior_weight(hosts, F.lit(corpus))
    rates = hosts.select("host", ((F.col("s") + F.lit(weight * corpus)) / (F.col("n") + F.lit(weight))).alias("host_rate"))
    sites = materialise(paths.join(rates, "host"), "sites")
    return sites, corpus, _prior_weight(sites, F.col("host_rate"))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, own_score, host_score, path_score, score, kept.

    ``labels`` (doc_id, quality) may cover some documents; several labels of a
    document are averaged, NULL ones are ignored. The scores are probabilities
    of a good document: by its own text, of its host, of its path without it,
    and all together; ``kept`` is score >= 0.5. NULL hosts or paths are a value
    of their own. Without labels of both kinds a document's own score is the
    labels' mean, or one half. An empty table gives an empty result.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")).alias("path"),
        F.col(f"`{text_col}`").alias("text"),
    )
    rows = materialise(features(rows), "features")
    rows = materialise(rows.join(known, "doc_id", "left"), "labelled")
    model = fit(rows.filter("label IS NOT NULL").withColumn("good", (F.col("label") >= 0.5).cast("double")))
    if model:
        linear = F.lit(model[1])
        for c, name in zip(model[0], FEATURES):
            linear = linear + F.lit(c) * F.col(name)
        own = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))
    else:
        own = F.lit(rows.agg(F.avg("label")).first()[0] or 0.5)
    rows = rows.select("doc_id", "host", "path", "label", own.alias("own")).withColumn("value", F.coalesce("label", "own"))
    rows = materialise(rows, "evidence")
    sites, corpus, weight = site_posteriors(rows)
    found = rows.join(sites, ["host", "path"])
    path_rate = (F.col("s") - F.col("value") + F.lit(weight) * F.col("host_rate")) / (F.col("n") - 1 + F.lit(weight))
    total = _odds(F.col("own")) + _odds(F.col("path_score")) - _odds(F.lit(corpus))
    return (
        found.withColumn("path_score", path_rate)
        .withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))
        .select("doc_id", F.col("own").alias("own_score"), F.col("host_rate").alias("host_score"), "path_score", "score", (F.col("score") >= KEEP).alias("kept"))
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
