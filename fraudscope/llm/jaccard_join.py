"""Join of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Copies: texts with the same shingle set form a copy class; a class is joined
   once, through its first document.
2. MinHash LSH forest: each class has ``TREES`` signatures of ``DEPTH`` minimum
   hashes. In each tree the signatures are sorted, so that those below one node
   of the prefix trie lie together. Pairs are matched from the full signature up:
   a prefix is shortened only where classes below the shorter one are not tied
   yet, and at most to the length at which a pair at the threshold meets in some
   tree with a chance of ``TARGET_RECALL`` (``prefix_length``). So nodes of copies
   end at full depth, others go to the shortest prefix. Pairs that meet are
   compared by their whole signatures, which tells pairs near the threshold from
   chance meetings; the survivors give edges to their smallest member.
3. Components of those edges are exact verification's units: each is cut into
   blocks of bounded size, and each pair of blocks counts the common shingles of
   all its pairs. So no pair inside a component is missed, and nothing of the
   size of a group squared is written: a block pair returns one row per class,
   its number of links and its smallest linked class.
4. Components of the verified links are the near-duplicate classes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudscope.llm.common import join_hot, materialise, one_of_repeats, table
from fraudscope.llm.components import components
from fraudscope.llm.hashing import mix, shingle_hashes, text_slices, word_hashes

#: A pair links when 5 * |A and B| >= 4 * |A or B|.
NUMERATOR, DENOMINATOR = 4, 5
TREES, DEPTH = 20, 6
TARGET_RECALL = 0.9999
#: Share of equal signature values from which a pair below a node is a candidate. At the threshold 0.8
#: and 120 values, a share of 0.55 or less has a chance below 1e-9.
CANDIDATE_SHARE = 0.55
#: Classes compared at a time, below a node and in a block: bounds a task's memory.
NODE_BLOCK, VERIFY_BLOCK = 512, 256

_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(1, 2**64 - 1, TREES * DEPTH, np.uint64)
_ODD = _RNG.integers(1, 2**64 - 1, TREES * DEPTH, np.uint64) | np.uint64(1)


def prefix_length(target: float = TARGET_RECALL, similarity: float = NUMERATOR / DENOMINATOR) -> int:
    """The longest prefix at which a pair meets in some tree with a chance of ``target``: no node is shortened further."""
    for depth in range(DEPTH, 0, -1):
        if 1 - (1 - similarity**depth) ** TREES >= target:
            return depth
    raise ValueError(f"{TREES} trees cannot reach a recall of {target}")


def _signature(shingles: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Minimum hashes of each text (rows) under each function (columns)."""
    out = np.empty((len(firsts), TREES * DEPTH), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(TREES * DEPTH):
            v = (((shingles ^ _XOR[k]) * _ODD[k]) >> np.uint64(32)).astype(np.uint32)
            out[:, k] = np.minimum.reduceat(v, firsts)
    return out


def _shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in a row, how many)."""
    h, counts = shingle_hashes(*word_hashes(buf, offsets))
    ends = np.cumsum(counts)
    sets = [np.unique(h[e - c : e]) for e, c in zip(ends, counts)]
    return (np.concatenate(sets) if sets else h), np.array([len(s) for s in sets], np.int64)


def _describe(batches):
    """Identity of the shingle set (two sums), its size, prefixes in each tree and signature."""
    import pyarrow as pa

    depth = prefix_length()
    for batch in batches:
        for first, buf, offsets in text_slices(batch.column("text")):
            sets, sizes = _shingle_sets(buf, offsets)
            n = len(sizes)
            keys = np.zeros((2, n), np.uint64)
            prefixes = np.zeros((n, TREES), np.uint64)
            sigs: list[bytes] = [b""] * n
            full = np.flatnonzero(sizes)
            if len(full):
                firsts = (np.cumsum(sizes) - sizes)[full]
                with np.errstate(over="ignore"):
                    for k in range(2):
                        keys[k, full] = np.add.reduceat(mix(sets ^ _XOR[k]), firsts)
                    sig = _signature(sets, firsts)
                    trees = sig.reshape(len(full), TREES, DEPTH)[:, :, :depth].astype(np.uint64)
                    h = np.zeros((len(full), TREES), np.uint64) + np.arange(1, TREES + 1, dtype=np.uint64)
                    for d in range(depth):
                        h = mix(h * np.uint64(31) + trees[:, :, d])
                    prefixes[full] = h
                for i, row in zip(full, sig):
                    sigs[i] = row.tobytes()
            own = batch.slice(first, n)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, n * TREES + 1, TREES, dtype=np.int32)), pa.array(prefixes.reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), own.column("th"), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                 pa.array(sizes), lists, pa.array(sigs, pa.binary())],
                names=["doc_id", "th", "k1", "k2", "size", "prefixes", "sig"],
            )


_DESCRIBED = "doc_id long, th long, k1 long, k2 long, size long, prefixes array<long>, sig binary"


def _complete_groups(frames, key: list[str]):
    """Frames cut so that no group of a sorted partition is split; a group is bounded by its blocks."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        tail = frame[key].iloc[-1]
        same = (frame[key] == tail).all(axis=1).to_numpy()
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut == 0 and held and (held[-1][key].iloc[-1] == tail).all():
            held.append(frame)
            continue
        done = pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
        if len(done):
            yield done
        held = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n rows is linked to through pairs (a, b), by any number of steps."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def descend(sig: np.ndarray, tree: np.ndarray, group: np.ndarray, own: np.ndarray, block: np.ndarray, across: np.ndarray):
    """(label of each class, shortest prefix compared in each group) of rows below nodes of a forest.

    Row i is the class ``own[i]`` (0, 1, ...) with the whole signature ``sig[i]``,
    below a node (``group``, ascending) of tree ``tree[i]``; where ``across`` holds, pairs
    inside one ``block`` are another task's. A label is the smallest class that
    ties lead to. A group whose classes are tied to one label is not shortened.
    """
    path = np.take_along_axis(sig, tree[:, None] * DEPTH + np.arange(DEPTH), axis=1)
    order = np.lexsort((*path.T[::-1], group))
    sig, path, group, own, block, across = (x[order] for x in (sig, path, group, own, block, across))
    need = CANDIDATE_SHARE * TREES * DEPTH
    label = np.arange(int(own.max()) + 1)
    reached = np.full(int(group.max()) + 1, DEPTH)

    def tie(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        apart = label[own[i]] != label[own[j]]
        i, j = i[apart], j[apart]
        for at in range(0, len(i), 1 << 16):
            k, m = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            ok = (sig[k] == sig[m]).sum(axis=1) >= need
            if ok.any():
                label = _smallest_linked(len(label), label[own[k[ok]]], label[own[m[ok]]])[label]

    for depth in range(DEPTH, prefix_length() - 1, -1):
        new = np.ones(len(own), bool)
        new[1:] = (group[1:] != group[:-1]) | (path[1:, :depth] != path[:-1, :depth]).any(axis=1)
        node, pivot = np.cumsum(new) - 1, np.flatnonzero(new)

        def untied() -> np.ndarray:
            """Rows below nodes that hold more than one label."""
            now = label[own]
            return np.flatnonzero(np.isin(node, node[now != now[pivot][node]]))

        rows = untied()
        reached[group[rows]] = depth
        tie(pivot[node[rows]], rows)
        rows = untied()
        for lag in range(1, len(rows)):
            i, j = rows[:-lag], rows[lag:]
            together = node[i] == node[j]
            if not together.any():
                break
            together &= ~across[i] | (block[i] != block[j])
            tie(i[together], j[together])
    return label, reached


def _below_nodes(frames):
    """Edges (a, b) from each class to the smallest one that signatures tie it to, node by node."""
    for part in _complete_groups(frames, ["node", "x", "y"]):
        keys = part[["node", "x", "y"]].to_numpy()
        group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
        # a class may lie in several groups of a part
        ids, own = np.unique(part.cid.to_numpy(), return_inverse=True)
        sig = np.frombuffer(b"".join(part.sig), np.uint32).reshape(len(part), -1)
        label, _ = descend(sig, part.tree.to_numpy(), group, own, part.block.to_numpy(), keys[:, 1] != keys[:, 2])
        moved = np.flatnonzero(label != np.arange(len(ids)))
        if len(moved):
            yield pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})


def _set_rows(batches):
    import pyarrow as pa

    for batch in batches:
        rest = [c for c in batch.schema.names if c != "text"]
        for first, buf, offsets in text_slices(batch.column("text")):
            sets, sizes = _shingle_sets(buf, offsets)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            own = batch.slice(first, len(sizes))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in rest), lists], names=[*rest, "shingles"])


def _count_links(block_pair: pd.DataFrame) -> pd.DataFrame:
    """(cid, links, root) of the classes of one pair of blocks, each pair of classes once."""
    rows = block_pair.drop_duplicates("cid").sort_values("cid", ignore_index=True)
    n, sizes = len(rows), rows.shingles.map(len).to_numpy()
    of = np.repeat(np.arange(n), sizes)
    _, column, df = np.unique(np.concatenate(rows.shingles.tolist()), return_inverse=True, return_counts=True)
    shared = df[column] > 1
    of, column = of[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # counts stay exact
    common = np.zeros((n, n), kind)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((n, 4096), kind)
        m[of[lo:hi], column[lo:hi] - at] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    total = sizes[:, None] + sizes[None, :] - common
    linked = DENOMINATOR * common >= NUMERATOR * total
    np.fill_diagonal(linked, False)
    block = rows.block.to_numpy()
    if rows.x.iat[0] != rows.y.iat[0]:
        linked &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(linked))
    cid = rows.cid.to_numpy()
    return pd.DataFrame({"cid": cid, "links": linked.sum(axis=1), "root": cid[_smallest_linked(n, a, b)]})


def _block_pairs(df: DataFrame, members: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks (x, y) that its own block is in; a small group is one pair."""
    blocks = F.ceil(F.col(members) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    df = df.withColumn("block", own).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return df.withColumn("x", F.least("block", "o")).withColumn("y", F.greatest("block", "o")).drop("o")


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(_describe, _DESCRIBED)


def _classes(described: DataFrame) -> DataFrame:
    """Copy classes: cid, k1, k2, first document (doc_id, th), n_copies, size, prefixes, sig."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("w")
    same = described.groupBy("k1", "k2", "size").agg(first, F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("prefixes").alias("prefixes"))
    same = same.select("k1", "k2", "size", "w.doc_id", "w.th", "n_copies", "sig", "prefixes")
    return materialise(same.withColumn("cid", F.monotonically_increasing_id()), "copy-classes")


def _candidates(classes: DataFrame) -> DataFrame:
    """(cid, root): classes that signatures tie to others, with the component they are verified in."""
    below = classes.filter("size > 0").select("cid", F.posexplode("prefixes").alias("tree", "node"))
    shared = below.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").withColumn("members", F.col("n"))
    met = materialise(join_hot(below, shared, "node", TREES * classes.count()), "met")
    pairs = _block_pairs(met.join(classes.select("cid", "sig"), "cid"), "members", NODE_BLOCK)
    dealt = pairs.select("node", "x", "y", "block", "tree", "cid", "sig").repartition("node", "x", "y")
    edges = dealt.sortWithinPartitions("node", "x", "y", "cid").mapInPandas(_below_nodes, "a long, b long")
    return components(edges, "candidates")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row table, class table): every row's shingle set (k1, k2, size), and every set's near-duplicate class.

    The class table has cid, k1, k2, size, its first document (doc_id, th),
    n_copies, n_links (other sets at 0.8 or more) and root (the smallest cid of
    the near-duplicate class).
    """
    described = materialise(_described(docs, id_col, text_col), "shingle-sets")
    classes = _classes(described)
    found = materialise(_candidates(classes), "found")
    units = found.groupBy("root").agg(F.count("*").alias("n")).withColumn("members", F.col("n"))
    members = join_hot(found, units, "root", found.count())
    wanted = members.select(F.col("node").alias("cid"), F.col("root").alias("unit"), "members").join(
        classes.select("cid", F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")), "cid"
    )
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    here = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.w_id) & (texts.th == wanted.w_th))
    sets = here.select("cid", "unit", "members", "text").mapInArrow(
        _set_rows, "cid long, unit long, members long, shingles array<long>"
    )
    blocks = _block_pairs(sets, "members", VERIFY_BLOCK)
    links = blocks.groupBy("unit", "x", "y").applyInPandas(_count_links, "cid long, links long, root long")
    links = materialise(links, "links")
    roots = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")), "links").withColumnRenamed("node", "cid")
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    out = classes.drop("sig", "prefixes").join(counts, "cid", "left").join(roots, "cid", "left")
    out = out.withColumn("n_links", F.coalesce("links", F.lit(0).cast("long"))).withColumn("root", F.coalesce("root", "cid"))
    return described.select("doc_id", "th", "k1", "k2", "size"), materialise(out.drop("links"), "near-classes")


def _first_documents(classes: DataFrame) -> DataFrame:
    """(root, first_id, first_th, n): the first document of each near-duplicate class, and its number of sets."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("w")
    return classes.groupBy("root").agg(first, F.count("*").alias("n")).select("root", F.col("w.doc_id").alias("first_id"), F.col("w.th").alias("first_th"), "n")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_id, n_copies, n_links.

    ``copy_id`` is the first document with the same shingle set, ``n_copies``
    how many rows have it; ``n_links`` counts the other shingle sets at a
    similarity of 0.8 or more, ``class_id`` is the first document that a chain
    of links leads to. First is the smallest id; NULL comes last. Texts of one
    to four words have one shingle; texts without words (NULL, empty) are
    copies of each other and link to nothing else. Repeated rows are copies.
    """
    rows, classes = near_duplicates(docs, id_col, text_col)
    named = join_hot(classes, _first_documents(classes), "root", classes.count()).select(
        "k1", "k2", "size", F.col("first_id").alias("class_id"), F.col("doc_id").alias("copy_id"), "n_copies", "n_links"
    )
    return rows.join(named, ["k1", "k2", "size"]).select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate class: its first. Repeated rows of it: any one."""
    _, classes = near_duplicates(docs, id_col, text_col)
    firsts = materialise(_first_documents(classes), "firsts")
    ident, th = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*columns).alias("row"), ident.alias("i"), th.alias("h"))
    kept = marked.join(firsts, F.col("i").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_th")), "left_semi")
    if not docs.groupBy(ident.alias("i"), th.alias("h")).count().filter("count > 1").isEmpty():
        kept = one_of_repeats(kept, ["i", "h"])
    return kept.select("row.*")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
