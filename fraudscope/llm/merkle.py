"""Merkle manifest of a dataset: a content-addressed store of nodes, and proofs found by descending it.

Leaves are numbered inside their tree (a range partitioning and a running offset per
partition, so no task holds a whole tree). A record of the store covers eight binary
levels, one digit of the rank in base 256: it maps a digest to its up to 256 children,
with the nodes between. Records are keyed by digest, so equal parts of a dataset share one.

A proof request descends from the root by the digits of its rank, the leading one
first: at each record it takes the child of its digit and collects the siblings it
passes by, one segment of the path a record. Requests with the same leading digits
travel as one row until they part, so a key of a join has 256 rows at most however
large the tree is. The segments, collected from the root down, are reversed into the
leaf-to-root order in which proofs are read.

Defined results: NULL values have a mark of their own (``-``), empty texts have length
0. NULL ids come first in their tree; rows with equal ids follow the order of their
digests, so repeated rows are leaves of their own with equal digests. NULL lang is a tree of its
own, the first. An empty table has no rows (and no root). Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraudscope.llm.common import materialise, table

#: Binary levels of a record, and its children.
DIGIT_BITS = 8
FAN = 1 << DIGIT_BITS


def node_hash(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenation."""
    return F.sha2(F.concat(*texts), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else its UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their ``rank`` (from 0) inside ``group`` by ``order``, and the group's size ``n``."""
    cut = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = materialise(cut.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)  # the id is the partition, then the row's place in it
    runs = placed.groupBy(part.alias("_part"), *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_run"))
    whole = Window.partitionBy(*group)
    before = F.sum("_run").over(whole.orderBy("_part")) - F.col("_run")
    runs = runs.withColumn("n", F.sum("_run").over(whole)).withColumn("_before", before)
    p, r = placed.alias("p"), runs.alias("r")
    same = F.shiftright("p._at", 33) == F.col("r._part")
    for g in group:
        same = same & F.col(f"p.{g}").eqNullSafe(F.col(f"r.{g}"))
    return p.join(r, same).select(
        *[F.col(f"p.{c}").alias(c) for c in rows.columns], (F.col("p._at") - F.col("r._first") + F.col("r._before")).alias("rank"), F.col("r.n").alias("n")
    )


def height(n: Column) -> Column:
    """Levels above the leaves of a tree with n of them: the least h with 2^h >= n."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _levels(n: Column, step: int) -> Column:
    """Binary levels that the records of this step (0: the lowest) cover."""
    return F.greatest(F.lit(0), F.least(F.lit(DIGIT_BITS), height(n) - F.lit(DIGIT_BITS * step)))


def _shift(rank: Column, step: int) -> Column:
    return F.shiftright(rank, min(63, DIGIT_BITS * step))


def _pairs(nodes: Column) -> Column:
    """The next level: every two consecutive nodes, the last run perhaps one alone."""
    at = F.sequence(F.lit(1), F.size(nodes), F.lit(2))
    return F.transform(at, lambda i: F.sha2(F.array_join(F.slice(nodes, i, 2), ""), 256))


@dataclass(frozen=True)
class Forest:
    """Trees over numbered leaves: their roots, and the records of all their nodes."""

    roots: DataFrame  # tree, digest
    records: list[DataFrame]  # from the lowest step up: digest, count (of levels), levels (arrays of digests, the children first)


def build(leaves: DataFrame, name: str) -> Forest:
    """``leaves``: tree long, rank long, n long (leaves of the tree), digest string."""
    most = leaves.agg(F.max(height(F.col("n")))).first()[0] or 0  # one row
    nodes, records = leaves.select("tree", "rank", "n", "digest"), []
    for step in range(-(-most // DIGIT_BITS)):
        children = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])  # FAN at most
        rows = nodes.groupBy("tree", "n", _shift(F.col("rank"), 1).alias("up")).agg(children.alias("l0")).withColumn("count", _levels(F.col("n"), step))
        for level in range(DIGIT_BITS):  # a level above the tree's root repeats it
            below = F.col(f"l{level}")
            rows = rows.withColumn(f"l{level + 1}", F.when(F.col("count") > level, _pairs(below)).otherwise(below))
        levels = F.array(*[f"l{level}" for level in range(DIGIT_BITS)])
        built = rows.select("tree", F.col("up").alias("rank"), "n", F.get(f"l{DIGIT_BITS}", F.lit(0)).alias("digest"), "count", levels.alias("levels"))
        built = materialise(built, f"{name}-{step}")
        nodes = built.select("tree", "rank", "n", "digest")
        # content-addressed: one record a digest, whatever number of nodes have it
        records.append(built.filter("count > 0").groupBy("digest").agg(F.first("count").alias("count"), F.first("levels").alias("levels")))
    return Forest(nodes.select("tree", "digest"), records)


def _segment(digit: Column) -> Column:
    """What a request passes by from a record's root down to the child ``digit``: whether the sibling is the left one, and its digest."""

    def at(level: Column) -> Column:
        own = F.call_function("shiftright", digit, level)
        return F.struct((own % 2 == 1).alias("left"), F.get(F.get("levels", level), own.bitwiseXOR(F.lit(1))).alias("digest"))

    return F.transform(F.sequence(F.col("count") - 1, F.lit(0), F.lit(-1)), at)


def descend(forest: Forest, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests (tree, rank and other columns), each with its leaf's digest and its path.

    ``starts``: one row a tree: tree, digest (its root), ``path`` (what was collected above
    it, root first: array of (left, digest)) and columns to carry along. In a path, a digest
    is NULL where a node was alone in its run.
    """
    along = [c for c in starts.columns if c not in ("tree", "digest", "path")]
    carriers = starts.withColumn("prefix", F.lit(0).cast("long"))
    for step in reversed(range(len(forest.records))):
        digits = _shift(F.col("rank"), step).alias("digits")
        wanted = requests.select("*", digits) if step == 0 else requests.select("tree", digits).distinct()
        records = forest.records[step].withColumnRenamed("digest", "of")
        opened = carriers.join(records, F.col("digest") == F.col("of"), "left").drop("of").withColumnRenamed("tree", "t")
        met = wanted.join(opened, (F.col("tree") == F.col("t")) & (_shift(F.col("digits"), 1) == F.col("prefix")))
        digit = (F.col("digits") % FAN).cast("int")
        there = F.col("count").isNotNull()  # else the tree's root lies lower
        child = F.when(there, F.get(F.get("levels", F.lit(0)), digit)).otherwise(F.col("digest"))
        path = F.when(there, F.concat("path", _segment(digit))).otherwise(F.col("path"))
        keep = requests.columns if step == 0 else ["tree"]
        carriers = met.select(*keep, *along, F.col("digits").alias("prefix"), child.alias("digest"), path.alias("path"))
    if not forest.records:
        carriers = requests.join(carriers, "tree")
    return carriers.drop("prefix")


def proof(path: Column) -> Column:
    """The path's siblings, leaf first."""
    return F.filter(F.transform(F.reverse(path), lambda s: s["digest"]), lambda d: d.isNotNull())


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` has with the siblings of ``path``."""

    def up(own: Column, s: Column) -> Column:
        paired = F.when(s["left"], node_hash(s["digest"], own)).otherwise(node_hash(own, s["digest"]))
        return F.when(s["digest"].isNull(), node_hash(own)).otherwise(paired)

    return F.aggregate(F.reverse(path), leaf, up)


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` (doc_id, lang, leaf and other columns) with subroot, root, path (root first) and the digest found at its end."""
    langs = ranked(leaves.select("lang").distinct(), [], ["lang"], "manifest-langs")
    langs = materialise(langs.select(F.col("lang").alias("of"), F.col("rank").alias("tree"), F.col("n").alias("trees")), "manifest-trees")
    numbered = ranked(leaves, ["lang"], ["doc_id", "leaf"], "manifest-order")
    numbered = materialise(numbered.join(langs, F.col("lang").eqNullSafe(F.col("of"))).drop("of", "trees"), "manifest-leaves")
    forest = build(numbered.select("tree", "rank", "n", F.col("leaf").alias("digest")), "manifest-store")
    tops = forest.roots.join(langs, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("trees").alias("n"), "digest")
    tops = materialise(tops, "manifest-subroots")
    top = build(tops, "manifest-top")
    root = top.roots.select("tree", "digest", F.expr("CAST(array() AS array<struct<left: boolean, digest: string>>)").alias("path"), F.col("digest").alias("root"))
    starts = descend(top, root, tops.select("tree", "rank"))
    starts = materialise(starts.select(F.col("rank").alias("tree"), "digest", "path", F.col("digest").alias("subroot"), "root"), "manifest-starts")
    return descend(forest, starts, numbered.drop("n"))


def dataset_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and tampered: the leaf after 1 is added to n_chars (itself where that is NULL), for the rows tampered with."""
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    own, changed = [field(F.col(c)) for c in names], [field(more if c == "n_chars" else F.col(c)) for c in names]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select("doc_id", "lang", node_hash(*own).alias("leaf"), F.when(hit, node_hash(*changed)).alias("tampered"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verification of every document; rows tampered with fail."""
    leaves = materialise(dataset_leaves(table(spark, sf_dir, "documents")), "manifest-documents")
    found = manifest(leaves).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    proof_hash = F.sha2(F.array_join(proof(F.col("path")), ""), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof_hash, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")) + ")"


#: The trees level by level, then every document's steps up, from the definition (no store, no descent).
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n,
    {_sql_leaf('n_chars')} AS leaf, {_sql_leaf('n_chars + 1')} AS changed,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 7 = 0 AS hit
  FROM documents),
nodes AS (
  SELECT lang, 0 AS level, rank AS idx, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2),
langs AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, rank AS idx, digest, n FROM langs
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, idx // 2),
steps AS (
  SELECT l.doc_id, p.level AS place, p.idx % 2 = 1 AS right_one, s.digest AS sibling
  FROM leaves l JOIN nodes p ON p.lang IS NOT DISTINCT FROM l.lang AND p.n > 1 AND p.idx = l.rank >> p.level
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = p.level AND s.idx = xor(p.idx, 1)
  UNION ALL
  SELECT l.doc_id, 1000 + p.level, p.idx % 2 = 1, s.digest
  FROM leaves l JOIN langs g ON g.lang IS NOT DISTINCT FROM l.lang JOIN tops p ON p.n > 1 AND p.idx = g.rank >> p.level
  LEFT JOIN tops s ON s.level = p.level AND s.idx = xor(p.idx, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM steps),
folds AS (
  SELECT doc_id, 0 AS k, CASE WHEN hit THEN changed ELSE leaf END AS digest FROM leaves
  UNION ALL
  SELECT f.doc_id, s.k, sha256(CASE WHEN s.sibling IS NULL THEN f.digest WHEN s.right_one THEN s.sibling || f.digest ELSE f.digest || s.sibling END)
  FROM folds f JOIN numbered s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY place), '')) AS proof_sha256, max(k) AS k FROM numbered GROUP BY doc_id)
SELECT l.doc_id, l.leaf, g.digest AS subroot, t.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
  f.digest AS folded_root, f.digest = t.digest AS verified
FROM leaves l JOIN langs g ON g.lang IS NOT DISTINCT FROM l.lang JOIN tops t ON t.n = 1 LEFT JOIN proofs p ON p.doc_id = l.doc_id
JOIN folds f ON f.doc_id = l.doc_id AND f.k = coalesce(p.k, 0)
"""
