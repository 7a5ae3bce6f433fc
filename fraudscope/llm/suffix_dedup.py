"""Removal of repeated passages through a sparse suffix array.

1. Suffixes: every window of 400 bytes chooses one place in it by content, so
   equal windows choose the same; only the suffixes at chosen places are kept,
   one for about 135 bytes of text (``suffixes.suffix_records``).
2. They are range-partitioned by their leading bytes with splitters that Spark
   samples, then by the hash of what follows, and sorted inside their partition.
   Equal suffixes are neighbours; each is compared with the one before and the
   one after, across partition boundaries too. Rows of a very common passage
   are many neighbours, which the splitters spread over partitions like any others.
3. A record whose whole body has an equal neighbour is repeated in all its
   windows. Those whose suffix is repeated but whose body is not lie at the edge
   of a passage: they are brought together by suffix, with one record of each
   repeated body, and compared window by window, byte for byte.
4. The repeated windows' bytes are cut out of each document.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudscope.llm.common import materialise, table
from fraudscope.llm.hashing import prefix_hash, text_slices
from fraudscope.llm.suffixes import WINDOW, byte_hashes, strong_hashes, suffix_records

#: Edge records of one suffix compared in a task; beyond that their windows are sorted like suffixes.
LOCAL_RECORDS = 1024
#: Bytes of edge records that are broadcast to the texts; beyond that the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Windows whose bytes are compared at a time, and edge records taken apart at a time.
COMPARED, TAKEN_APART = 1 << 14, 256
#: Bytes of text, or of edge records, that a worker holds in arrays at a time (a longer text is held whole).
HELD_BYTES = 1 << 18

_RECORD = "doc_id long, th long, a int, n int, lead long, gram long, body long, tail long"
_MARKS = "prev_gram boolean, prev_body boolean, next_gram boolean, next_body boolean, edge int, part int"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by identity: the id and a hash of the text (rows equal in both are treated alike)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _records(batches):
    import pyarrow as pa

    for batch in batches:
        for first, buf, offsets in text_slices(batch.column("text"), HELD_BYTES):
            r = suffix_records(buf, offsets)
            own = pa.array(first + r["text"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(own), batch.column("th").take(own),
                 *(pa.array(r[c].astype(np.int32)) for c in ("a", "n")), *(pa.array(r[c]) for c in ("lead", "gram", "body", "tail"))],
                names=["doc_id", "th", "a", "n", "lead", "gram", "body", "tail"],
            )


def _mark(batches):
    """The rows of a sorted partition that are equal to the row before or after them, with which of the two.

    The first and last row of the partition are marked as its edges and stay in
    any case: one of their neighbours is in another partition.
    """
    import pyarrow as pa

    part = TaskContext.get().partitionId()
    held, known = None, None  # the last row, and whether the row before it is equal

    def out(rows, pg, pb, ng, nb, edge):
        marks = [pa.array(pg), pa.array(pb), pa.array(ng), pa.array(nb), pa.array(edge, pa.int32()), pa.array(np.full(len(edge), part, np.int32))]
        names = [*rows.schema.names, "prev_gram", "prev_body", "next_gram", "next_body", "edge", "part"]
        return pa.Table.from_arrays([*rows.columns, *marks], names=names).filter(pa.array(pg | ng | (edge > 0))).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        lead, gram, body, tail = (rows.column(c).to_numpy() for c in ("lead", "gram", "body", "tail"))
        same_gram = (lead[1:] == lead[:-1]) & (gram[1:] == gram[:-1])
        same_body = same_gram & (body[1:] == body[:-1]) & (tail[1:] == tail[:-1])
        pg, pb = (np.concatenate([[k], s]) for k, s in zip(known or (False, False), (same_gram, same_body)))
        edge = np.zeros(len(lead), np.int32)
        edge[0] = 1 if known is None else 0
        n = len(lead) - 1
        if n:
            yield from out(rows.slice(0, n), pg[:n], pb[:n], same_gram, same_body, edge[:n])
        held, known = rows.slice(n), (bool(pg[n]), bool(pb[n]))
        if n == 0 and edge[0]:
            known = None  # still the first row
    if held is not None:
        pg, pb = known or (False, False)
        no = np.zeros(1, bool)
        yield from out(held, np.array([pg]), np.array([pb]), no, no, np.array([3 if known is None else 2], np.int32))


def mark_repeats(rows: DataFrame, schema: str, name: str) -> DataFrame:
    """Those of ``rows`` (lead, gram, body, tail and others, see ``schema``) with an equal neighbour in sorted order, and with which.

    Rows that are equal to neither neighbour are not written, except at the edges of partitions.
    """
    spark, columns = rows.sparkSession, rows.columns
    keys = ["lead", "gram", "body", "tail"]
    order = [*keys, *[c for c in columns if c not in keys]]
    marked = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_mark, f"{schema}, {_MARKS}")
    marked = materialise(marked, name)
    # two rows of a partition at most, whatever it holds
    edges = [r.asDict() for r in marked.filter("edge > 0").collect()]
    edges.sort(key=lambda r: (r["part"], r["edge"]))
    for one, two in zip(edges, edges[1:]):
        if one["part"] != two["part"]:
            gram = (one["lead"], one["gram"]) == (two["lead"], two["gram"])
            body = gram and (one["body"], one["tail"]) == (two["body"], two["tail"])
            one["next_gram"], one["next_body"], two["prev_gram"], two["prev_body"] = gram, body, gram, body
    inner = marked.filter("edge = 0")
    if not edges:
        return inner
    return inner.unionByName(spark.createDataFrame([tuple(r[c] for c in marked.columns) for r in edges], marked.schema))


def _contexts(batches):
    """The bytes of each edge record."""
    import pyarrow as pa

    names = ("doc_id", "th", "a", "gram", "single", "bytes")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    rows, held = [], 0
    for batch in batches:
        for doc_id, th, text, records in zip(*(batch.column(c) for c in ("doc_id", "th", "text", "records"))):
            raw = text.as_py().encode()
            for r in records.as_py():
                rows.append((doc_id.as_py(), th.as_py(), r["a"], r["gram"], r["single"], raw[r["a"] : r["a"] + r["n"] - 1 + WINDOW]))
                held += len(rows[-1][-1])
                if held >= HELD_BYTES:
                    yield out(rows)
                    rows, held = [], 0
    if rows:
        yield out(rows)


_CONTEXT = "doc_id long, th long, a int, gram long, single boolean, bytes binary"


def _windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start of each window of each body in a row, windows of each body)."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    buf = np.frombuffer(b"".join(bodies), np.uint8)
    count = sizes - WINDOW + 1
    last = np.cumsum(count)
    return buf, np.repeat(np.cumsum(sizes) - sizes - (last - count), count) + np.arange(int(last[-1])), count


def repeated_windows(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each window of WINDOW bytes occurs more than once among those at ``starts``.

    Hashes find the candidates; each is compared byte for byte with the first of its hash, and
    where windows of one hash differ, they are grouped by their bytes.
    """
    h = byte_hashes(buf, starts, starts + WINDOW, prefix_hash(buf))
    _, first, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    hit = times[which] > 1
    k, mixed, windows = np.flatnonzero(hit), set(), np.lib.stride_tricks.sliding_window_view(buf, WINDOW)
    for i in range(0, len(k), COMPARED):
        own = k[i : i + COMPARED]
        same = (windows[starts[own]] == windows[starts[first[which[own]]]]).all(axis=1)
        mixed.update(which[own[~same]].tolist())
    if mixed:
        k = k[np.isin(which[k], list(mixed))]
        raw = [buf[a : a + WINDOW].tobytes() for a in starts[k]]
        count = Counter(raw)
        hit[k] = [count[b] > 1 for b in raw]
    return hit


def _runs(hit: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, first, last + 1) of the runs of hits; ``of`` and ``at`` give each window's record and place."""
    k = np.flatnonzero(hit)
    if not len(k):
        return k, k, k
    new = np.concatenate([[True], (of[k][1:] != of[k][:-1]) | (at[k][1:] != at[k][:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1
    return of[k[first]], at[k[first]], at[k[last]] + 1


def _compare_windows(batches):
    """Spans (s, e) of the single records' windows that another record of the same suffix has too.

    Rows come sorted by suffix; those of one suffix lie together, and are at
    most ``LOCAL_RECORDS``.
    """
    import pyarrow as pa

    def spans(rows):
        buf, starts, count = _windows(rows.column("bytes").to_pylist())
        of = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
        hit = repeated_windows(buf, starts) & rows.column("single").to_numpy(zero_copy_only=False)[of]
        record, first, last = _runs(hit, of, at)
        take = pa.array(record)
        a = rows.column("a").to_numpy()[record]
        return pa.Table.from_arrays(
            [rows.column("doc_id").take(take), rows.column("th").take(take), pa.array((a + first).astype(np.int32)),
             pa.array((a + last - 1 + WINDOW).astype(np.int32))],
            names=["doc_id", "th", "s", "e"],
        ).to_batches()

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        gram = rows.column("gram").to_numpy()
        if not len(gram):
            continue
        cut = int(np.searchsorted(gram, gram[-1], "left"))
        for part in _by_size(rows.slice(0, cut), gram[:cut]):
            yield from spans(part)
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield from spans(held)


def _by_size(rows, gram: np.ndarray):
    """Slices of about ``LOCAL_RECORDS`` rows that do not split a suffix."""
    at = 0
    while at < len(gram):
        end = min(at + LOCAL_RECORDS, len(gram))
        end = int(np.searchsorted(gram, gram[end - 1], "right"))
        yield rows.slice(at, end - at)
        at = end


def _window_rows(batches):
    """A row per window of the edge records, with the digest of its bytes in place of the order's keys."""
    import pyarrow as pa

    for batch in batches:
        for i in range(0, batch.num_rows, TAKEN_APART):
            some = batch.slice(i, TAKEN_APART)
            buf, starts, count = _windows(some.column("bytes").to_pylist())
            lead, body = strong_hashes(buf, starts, starts + WINDOW)
            of = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id").take(take), some.column("th").take(take),
                 pa.array((some.column("a").to_numpy()[of] + place).astype(np.int32)), pa.array(lead),
                 some.column("gram").take(take), pa.array(body), pa.array(np.zeros(len(of), np.int64)), some.column("single").take(take)],
                names=["doc_id", "th", "a", "lead", "gram", "body", "tail", "single"],
            )


_WINDOW_ROW = "doc_id long, th long, a int, lead long, gram long, body long, tail long, single boolean"
_SPAN = "doc_id long, th long, s int, e int"


def _edge_spans(edge: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans of edge records (``_RECORD`` columns and ``single``) whose windows are repeated."""
    with_single = edge.filter("single").select("gram").distinct()
    wanted = edge.join(with_single, "gram", "left_semi").groupBy("doc_id", "th").agg(
        F.collect_set(F.struct("a", "n", "gram", "single")).alias("records")
    )
    wanted = materialise(wanted.withColumnRenamed("doc_id", "w_id").withColumnRenamed("th", "w_th"), "edge-docs")
    docs, records = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("records")), F.lit(0))).first()
    if 100 * docs + 50 * records <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    here = texts.join(wanted, texts.doc_id.eqNullSafe(F.col("w_id")) & (texts.th == F.col("w_th")))
    contexts = materialise(here.select("doc_id", "th", "text", "records").mapInArrow(_contexts, _CONTEXT), "contexts")
    many = contexts.groupBy("gram").count().filter(F.col("count") > LOCAL_RECORDS).select("gram")
    few = contexts.join(many, "gram", "left_anti").select(*contexts.columns)
    local = few.repartitionByRange("gram").sortWithinPartitions("gram").mapInArrow(_compare_windows, _SPAN)
    rows = contexts.join(many, "gram", "left_semi").select(*contexts.columns).mapInArrow(_window_rows, _WINDOW_ROW)
    marked = mark_repeats(rows, _WINDOW_ROW, "edge-windows").filter("single and (prev_body or next_body)")
    return local.unionByName(marked.select("doc_id", "th", F.col("a").alias("s"), (F.col("a") + WINDOW).alias("e")))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            raw = text.as_py().encode()
            gone = _merged(spans.as_py() or [])
            digest, at = hashlib.sha256(), 0
            for s, e in gone:
                digest.update(raw[at:s])
                at = e
            digest.update(raw[at:])
            rows.append((len(raw), sum(e - s for s, e in gone), len(gone), digest.hexdigest(), [{"s": s, "e": e} for s, e in gone]))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, spans): byte spans, with overlaps, of the strings of 400 bytes that start anywhere else too."""
    texts = _texts(docs, id_col, text_col)
    records = materialise(texts.mapInArrow(_records, _RECORD), "suffixes")
    marked = mark_repeats(records, _RECORD, "sorted-suffixes").filter("prev_gram or next_gram")
    whole = F.col("prev_body") | F.col("next_body")
    resolved = marked.filter(whole).select("doc_id", "th", F.col("a").alias("s"), (F.col("a") + F.col("n") - 1 + WINDOW).alias("e"))
    # of a repeated body, the rows that border on another body of the same suffix
    borders = (~F.col("prev_body") & F.col("prev_gram")) | (~F.col("next_body") & F.col("next_gram"))
    edge = marked.filter(borders).withColumn("single", ~whole)
    spans = resolved.unionByName(_edge_spans(edge, texts))
    return spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A text's bytes go where a string of 400 bytes covers them that also starts
    anywhere else, in the same text too. ``spans`` are the maximal removed runs
    (start, end in UTF-8 bytes). NULL texts are empty; texts shorter than 400
    bytes keep everything; repeated rows are repeats of each other.
    """
    texts = _texts(docs, id_col, text_col)
    spans = materialise(repeated_spans(docs, id_col, text_col), "spans").select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "spans")
    found = texts.join(spans, texts.doc_id.eqNullSafe(spans.s_id) & (texts.th == spans.s_th), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:int,e:int>>"
    return found.select("doc_id", "text", "spans").mapInArrow(_cut, schema)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
