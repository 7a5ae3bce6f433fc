"""Exact top-k search by integer inner product over a vector-approximation file.

1. Rows with equal vectors are one class: only its k + 1 smallest ids can be among
   anyone's first k (ties go to the smaller id, and a query leaves out itself).
   Copies are thinned out by salted windows first, so a very common vector is
   not one task's work.
2. The approximation file: blocks of about ``BLOCK`` classes, one row each, with
   8 bits a component (256 cells of equal population) and each cell's smallest and largest
   value. A block of queries meets a block of the file; two matrix products give
   every upper and lower bound. What cannot reach the block's (k + 1)th largest
   lower bound goes.
3. Exact vectors are read in the order of the bounds, best first: the leading ones
   of each query, then only those whose bound still reaches the kth exact score.
   After that the result is certain.

Work grows with queries x vectors, as any exact search does; what crosses the
network is each query once per block of the file, each block of the file (an
eighth of the vectors as longs, and the cells' ranges) once per block of queries, and the few candidates left.

Defined results: a vector that is NULL, holds a NULL or a non-finite component, or has no id
takes no part. Vectors meet only those of their own length. Each repeated row
counts by itself: a query leaves out one row with its id and vector, its own. An
empty table gives no rows; a query alone in the table gives none either. Scaled components must
stay below 2^62 and scores must fit a long, else the job raises.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from fraudscope.llm.common import materialise, table

#: Classes of a block of the approximation file, and query classes of a block, on average: they bound a task's memory.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Cells of a component (8 bits).
CELLS = 256
#: Queries whose bounds are worked out at a time.
STRIP = 64
#: Parts into which the copies of one vector are thinned out first.
SALTS = 16

_NO_BOUND = -(2**63)
_FILE = "dim int, block int, cids binary, cells binary, lo binary, hi binary"
_CANDIDATES = "qid long, cid long, upper long, least long"


def _integers(factor: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vec = batch.column("vec")
            values = np.floor(factor * vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if len(values) and np.abs(values).max() >= 2**62:
                raise ValueError("a scaled component of a vector does not fit a long")
            sizes = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int64)
            packed = pa.Array.from_buffers(pa.large_binary(), len(vec), [None, pa.py_buffer(ends), pa.py_buffer(values.astype("<i8").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sizes.astype(np.int32)), packed.cast(pa.binary())], names=["vec_id", "dim", "vec"])

    return run


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, factor: float) -> DataFrame:
    """(vec_id, dim, vec): floor(factor * component) as little-endian longs, of the rows that take part."""
    vec, whole = F.col(f"`{vec_col}`"), F.lit(float("inf"))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < whole))
    own = rows.filter(F.col(f"`{id_col}`").isNotNull() & vec.isNotNull() & finite)
    own = own.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.cast("array<double>").alias("vec"))
    return own.mapInArrow(_integers(factor), "vec_id long, dim int, vec binary")


def equal_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(cid, dim, vec, ids): one row per distinct vector with its k + 1 smallest ids (repeated ones repeated)."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    first = Window.partitionBy("vec", "salt").orderBy("vec_id")
    few = vectors.withColumn("salt", salt).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1)
    ids = F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1)  # of SALTS x (k + 1) at most
    one = few.groupBy("vec", "dim").agg(ids.alias("ids"))
    return one.select(F.monotonically_increasing_id().alias("cid"), "dim", "vec", "ids")


def _matrix(vecs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<i8").reshape(-1, dim) if dim else np.zeros((len(vecs), 0), np.int64)


def _approximate(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of the approximation file: a byte a component, and the range of what lies in each cell."""
    dim = int(rows["dim"].iloc[0])
    x = _matrix(rows.vec, dim)
    cells, lo, hi = np.zeros(x.shape, np.uint8), np.zeros((dim, CELLS), "<i8"), np.zeros((dim, CELLS), "<i8")
    ordered = np.sort(x, axis=0)
    cuts = ordered[(np.arange(1, CELLS) * len(x)) // CELLS]
    for d in range(dim):
        cells[:, d] = np.searchsorted(cuts[:, d], x[:, d], "right")
        there, first = np.unique(np.searchsorted(cuts[:, d], ordered[:, d], "right"), return_index=True)
        lo[d, there], hi[d, there] = ordered[first, d], ordered[np.append(first[1:], len(x)) - 1, d]
    return pd.DataFrame(
        {"dim": [dim], "block": [int(rows["block"].iloc[0])], "cids": [rows.cid.to_numpy("<i8").tobytes()],
         "cells": [cells.tobytes()], "lo": [lo.tobytes()], "hi": [hi.tobytes()]}
    )


def _ranges(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class ids, lower and upper end of each component's cell) of a row of the approximation file."""
    cids, dim = np.frombuffer(row.cids, "<i8"), int(row.dim)
    cells = np.frombuffer(row.cells, np.uint8).reshape(len(cids), dim)
    lo, hi = (np.frombuffer(b, "<i8").reshape(dim, CELLS) for b in (row.lo, row.hi))
    at = np.arange(dim)
    return cids, lo[at, cells], hi[at, cells]


def bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of queries with vectors that lie between ``lo`` and ``hi``."""
    most = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(lo).max(initial=0)), int(np.abs(hi).max(initial=0)))
    kind = np.float64 if most * max(1, queries.shape[1]) < 2**51 else object  # exact in either
    q, mid, half = queries.astype(kind), (lo.astype(kind) + hi.astype(kind)).T, (hi.astype(kind) - lo.astype(kind)).T
    centre, radius = q @ mid, np.abs(q) @ half  # twice the true ones, so that they are whole numbers
    return (centre - radius) // 2, (centre + radius) // 2


def _scan(k: int):
    def run(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples():
            cids, lo, hi = _ranges(row)
            q = _matrix(queries.vec, int(row.dim)) if len(queries) else []
            for s in range(0, len(q), STRIP):
                lower, upper = bounds(q[s : s + STRIP], lo, hi)
                qids = queries.cid.to_numpy()[s : s + STRIP]
                if len(cids) > k:  # of the k + 1 best one may be the query itself
                    least = np.partition(lower, len(cids) - k - 1, axis=1)[:, len(cids) - k - 1]
                    i, j = np.nonzero(upper >= least[:, None])
                    floor = least[i]
                else:
                    i, j = np.nonzero(np.ones(upper.shape, bool))
                    floor = np.full(len(i), _NO_BOUND, object)
                out.append(pd.DataFrame({"qid": qids[i], "cid": cids[j], "upper": [int(v) for v in upper[i, j]], "least": [int(v) for v in floor]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("qid", "cid", "upper", "least")})

    return run


@F.pandas_udf(LongType())
def _inner(a: pd.Series, b: pd.Series) -> pd.Series:
    """Inner products of pairs of packed vectors of equal length."""
    sizes = a.str.len().to_numpy() // 8
    x, y = (np.frombuffer(b"".join(s), "<i8") for s in (a, b))
    if len(x) and int(np.abs(x).max()) * int(np.abs(y).max()) * int(sizes.max()) >= 2**63:
        x, y = x.astype(object), y.astype(object)
    sums, products = np.zeros(len(sizes), x.dtype), x * y
    if len(products):
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        sums[sizes > 0] = np.add.reduceat(products, starts)
    return pd.Series([int(s) for s in sums])


def _read_exact(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """(qid, cid, ids, score): the candidates with their exact scores."""
    own = classes.select("cid", "vec", "ids")
    asked = classes.select(F.col("cid").alias("qid"), F.col("vec").alias("qvec"))
    return candidates.select("qid", "cid").join(own, "cid").join(asked, "qid").select("qid", "cid", "ids", _inner("qvec", "vec").alias("score"))


def exact_top_k(rows: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int, factor: float = 1.0) -> DataFrame:
    """The k rows with the largest inner product for every query: query_id, rank (from 1), vec_id, score.

    ``is_query``: a predicate on the column ``vec_id``, the row's id. Ties go to the smaller id.
    """
    vectors = integer_vectors(rows, id_col, vec_col, factor)
    classes = materialise(equal_vectors(vectors, k), "vector-classes")
    asked = materialise(vectors.filter(is_query).join(classes.select("cid", "vec"), "vec").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")), "vector-queries")
    query_classes = classes.join(asked.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi").select("cid", "dim", "vec")
    blocks, strips = max(1, -(-classes.count() // BLOCK)), max(1, -(-query_classes.count() // QUERY_BLOCK))

    dealt = classes.select("cid", "dim", "vec", F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int").alias("block"))
    file = materialise(dealt.groupBy("dim", "block").applyInPandas(_approximate, _FILE), "vector-file")
    each_block, each_strip = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, strips))
    left = query_classes.withColumn("strip", F.pmod(F.xxhash64("cid"), F.lit(strips)).cast("int")).withColumn("block", each_block)
    met = left.groupBy("dim", "block", "strip").cogroup(file.withColumn("strip", each_strip).groupBy("dim", "block", "strip"))
    found = met.applyInPandas(_scan(k), _CANDIDATES)

    one = Window.partitionBy("qid")
    found = found.withColumn("least", F.max("least").over(one)).filter("upper >= least")
    found = materialise(found.withColumn("at", F.row_number().over(one.orderBy(F.desc("upper"), "cid"))).drop("least"), "vector-candidates")
    leading = 2 * (k + 1)
    first = materialise(_read_exact(found.filter(F.col("at") <= leading), classes), "vector-first")
    kth = first.groupBy("qid").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("kth"))
    more = found.filter(F.col("at") > leading).join(kth, "qid").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    scored = first.unionByName(_read_exact(more, classes)).withColumn("vec_id", F.explode("ids"))

    best = F.struct((-F.col("score")).alias("down"), "vec_id", "cid")
    hits = scored.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(best)), 1, k + 1).alias("hits"))
    own = F.array_position(F.transform("hits", lambda h: (h["cid"] == F.col("qid")) & (h["vec_id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("hits", lambda h, i: i + 1 != F.col("own")), 1, k)
    out = asked.join(hits, "qid").withColumn("own", own).select("query_id", F.posexplode(others).alias("at", "h"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("h.vec_id").alias("vec_id"), (-F.col("h.down")).alias("score"))


#: Results of a query, and what the components are multiplied by before they are cut to integers.
TOP_K, FACTOR = 20, 64.0


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every vector whose id is divisible by 20."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, TOP_K, FACTOR)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
