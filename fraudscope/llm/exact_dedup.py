"""Exact dedup through a minimal perfect hash over the digests already seen.

The corpus comes in two batches: the history, and what is new. The history's
distinct digests are split into shards of bounded size by hash; each shard is
one row of an index table with a minimal perfect hash (a seed for each small
bucket of digests) and a slot array that holds the whole digests and the
locators of the winners. A new digest is looked up in its shard: its bucket's
seed names one slot, and the slot's 32 bytes are compared. Equal bytes: a
repeat of the history. Otherwise it is no member, and stays as a group of its
own among the new rows.

Only distinct digests with their counts reach the shards (rows are aggregated
on the map side first), so the size of a group of copies does not matter there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudscope.llm.common import free_name, materialise, one_of_repeats, table, text_digest

#: Distinct digests of a shard, on average: bounds a task's memory (about 100 bytes each).
SHARD_DIGESTS = 4096
#: Digests of a bucket of the perfect hash, on average.
BUCKET = 4
#: Seeds tried at a time, and in all before a bucket counts as impossible (never seen with distinct digests).
SEEDS_AT_ONCE, MOST_SEEDS = 64, 1 << 22

_CLASS = "digest binary, no_id boolean, keep_id long, rid long, n long"
_INDEX = "shard int, seeds binary, slots binary, no_id binary, keep_id binary, rid binary, n binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slot(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(h + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of SHA-256 digests (n x 32 bytes): their bytes 0-7 and 8-15."""
    w = digests.view("<u8")
    return w[:, 0], w[:, 1]


def perfect_hash(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, slot of each digest) of a minimal perfect hash over distinct digests (n x 32 bytes).

    Buckets are placed from the largest down, each with the first seed that
    sends all its digests to free slots.
    """
    n = len(digests)
    first, second = _halves(digests)
    buckets = max(1, -(-n // BUCKET))
    of = (first % np.uint64(buckets)).astype(np.int64)
    seeds, slots, taken = np.zeros(buckets, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(buckets + 1))
    for b in np.argsort(-np.diff(ends), kind="stable"):
        rows = order[ends[b] : ends[b + 1]]
        if not len(rows):
            break
        seed = 0
        while True:
            tries = np.arange(seed, seed + SEEDS_AT_ONCE)
            at = _slot(second[rows][None, :], tries[:, None], n)
            ok = ~taken[at].any(axis=1)
            if len(rows) > 1:
                s = np.sort(at, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if ok.any():
                k = int(np.argmax(ok))
                seeds[b], slots[rows] = tries[k], at[k]
                taken[at[k]] = True
                break
            seed += SEEDS_AT_ONCE
            if seed > MOST_SEEDS:
                raise ValueError("no perfect hash: are the digests distinct?")
    return seeds, slots


def lookup(seeds: np.ndarray, slots: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Slot of each digest, or -1 where the slot's 32 bytes are others."""
    first, second = _halves(digests)
    seed = seeds[(first % np.uint64(len(seeds))).astype(np.int64)]
    at = _slot(second, seed, len(slots))
    return np.where((slots[at] == digests).all(axis=1), at, -1)


def _matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    d = _matrix(shard.digest)
    seeds, slots = perfect_hash(d)
    order = np.argsort(slots)

    def column(name, kind):
        return shard[name].to_numpy().astype(kind)[order].tobytes()

    return pd.DataFrame(
        {
            "shard": [int(shard["shard"].iloc[0])],
            "seeds": [seeds.tobytes()],
            "slots": [d[order].tobytes()],
            "no_id": [column("no_id", np.bool_)],
            "keep_id": [column("keep_id", np.int64)],
            "rid": [column("rid", np.int64)],
            "n": [column("n", np.int64)],
        }
    )


def _probe(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Classes of a shard: each slot with its repeats among the new digests, then the nonmembers."""
    own = new[["digest", "no_id", "keep_id", "rid", "n"]]
    if not len(index):
        return own
    row = index.iloc[0]
    slots = np.frombuffer(row.slots, np.uint8).reshape(-1, 32)
    no_id, keep_id, rid, n = (
        np.frombuffer(row[c], k).copy()
        for c, k in (("no_id", np.bool_), ("keep_id", np.int64), ("rid", np.int64), ("n", np.int64))
    )
    member = np.zeros(len(own), bool)
    if len(own):
        at = lookup(np.frombuffer(row.seeds, np.int64), slots, _matrix(own.digest))
        member = at >= 0
        hit, at = own[member], at[member]
        n[at] += hit.n.to_numpy()
        mine = list(zip(no_id[at], keep_id[at], rid[at]))
        theirs = list(zip(hit.no_id, hit.keep_id, hit.rid))
        for k, a, b in zip(at, mine, theirs):
            no_id[k], keep_id[k], rid[k] = min(a, b)
    seen = pd.DataFrame({"digest": [x.tobytes() for x in slots], "no_id": no_id, "keep_id": keep_id, "rid": rid, "n": n})
    return pd.concat([seen, own[~member]], ignore_index=True)


def _distinct(rows: DataFrame) -> DataFrame:
    """Distinct digests: the first row in the order (NULL ids last, id, row number) and the count."""
    first = F.min(F.struct("no_id", "keep_id", "rid")).alias("w")
    return rows.groupBy("digest").agg(first, F.count("*").alias("n")).select("digest", "w.*", "n")


def digest_classes(history: DataFrame, new: DataFrame, n_rows: int) -> DataFrame:
    """(digest, no_id, keep_id, rid, n) of every distinct digest of both batches.

    Both take ``digest binary, no_id boolean, keep_id long, rid long``;
    ``n_rows`` bounds their distinct digests and sets the number of shards.
    """
    shards = max(1, math.ceil(n_rows / SHARD_DIGESTS))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    index = _distinct(history).select("*", shard).groupBy("shard").applyInPandas(_build, _INDEX)
    probe = _distinct(new).select("*", shard)
    return probe.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe, _CLASS)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Ids below the middle of the id range are the history, the others (and NULL
    ids) are new; the result does not depend on where the cut lies. Texts are
    equal when they are after each run of white space is replaced by one space;
    NULL counts as empty, and empty texts are equal. Of equal texts the
    smallest id stays, NULL only where there is no other; of repeated rows with
    that id exactly one is kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ident = F.col(f"`{id_col}`").cast("long")
    rows = materialise(
        docs.select(
            ident.alias("doc_id"),
            ident.isNull().alias("no_id"),
            F.coalesce(ident, F.lit(0).cast("long")).alias("keep_id"),
            F.monotonically_increasing_id().alias("rid"),
            text_digest(F.col(f"`{text_col}`")).alias("digest"),
        ),
        "exact-rows",
    )
    # one row whatever the input
    lo, hi, n_rows = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    seen = F.lit(False) if lo is None else F.coalesce(F.col("doc_id") < lo + (hi - lo + 1) // 2, F.lit(False))
    parts = [rows.filter(c).select("digest", "no_id", "keep_id", "rid") for c in (seen, ~seen)]
    classes = materialise(digest_classes(*parts, n_rows), "exact-classes").select(
        F.col("digest"), F.when(~F.col("no_id"), F.col("keep_id")).alias("winner"), F.col("rid").alias("winner_rid"), "n"
    )
    return rows.select("doc_id", "rid", "digest").join(classes, "digest").select(
        "doc_id",
        F.col("winner").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rid") == F.col("winner_rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with their columns, whatever their names.

    NULL text counts as empty, and empty texts are equal; a row with a NULL id
    stays only where no other has its text. Of rows that repeat an id with an
    equal text the least by all columns stays (:func:`one_of_repeats`). An empty
    table gives an empty one.
    """
    won = materialise(exact_duplicates(docs, id_col, text_col), "exact-kept")
    # ids and digests are known by now: whole texts meet their id, not all copies of one text
    repeats = won.groupBy("doc_id", "text_sha256").count().filter("count > 1").limit(1).count() > 0
    sha, wid, wsha = (free_name(docs.columns, c) for c in ("sha", "wid", "wsha"))
    winners = won.filter("kept").select(F.unhex("text_sha256").alias(wsha), F.col("doc_id").alias(wid))
    found = docs.withColumn(sha, text_digest(F.col(f"`{text_col}`")))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(wid)) & (F.col(sha) == F.col(wsha))
    found = found.join(winners, same, "left_semi")
    if repeats:
        found = one_of_repeats(found, [sha])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
