"""Packing documents into sequences: best fit, then a swap-based local search.

Documents are tokenised where they lie and cut into pieces; only the pieces'
lengths and places go on. The pieces are dealt at random into cells of bounded
size. Each cell is packed by best fit and improved by local search: the emptiest
bins are taken apart by moving, exchanging one for one, or two for one, always
so that the sum of squared fills grows, until the room left is less than a bin
or no bin can be changed. The bins that stay underfull are dealt, whole, into
the next round's cells, and the search goes on.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudscope.llm.common import materialise, table
from fraudscope.llm.word_bpe import WordBpe, default_path

CAPACITY = 2048
#: Pieces of a cell, on average: bounds a task's memory and time.
CELL_PIECES = 8192
#: A bin filled at least this far is done; the others go to the next round.
DONE_FILL = CAPACITY

#: Id 0, as it counts in the checksums.
_ZERO = bytes(4)

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"rid long, {_PIECES}, sequence_id long, fill int, offset long"


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of rows) by best fit, longest pieces first."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # the rooms that some open bin has, sorted
    at: dict[int, list[int]] = defaultdict(list)
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        k = bisect.bisect_left(rooms, size)
        if k == len(rooms):
            bins.append([int(i)])
            b, room = len(bins) - 1, capacity - size
        else:
            room = rooms[k]
            b = at[room].pop()
            if not at[room]:
                rooms.pop(k)
            bins[b].append(int(i))
            room -= size
        if room > 0:
            if not at[room]:
                bisect.insort(rooms, room)
            at[room].append(b)
    return bins


class _Search:
    """The state of a local search: bins, their fills, and the open bins that hold each sum of rows, by room."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.size, self.cap = bins, [int(x) for x in lengths], capacity
        self.fill = [sum(self.size[i] for i in b) for b in bins]

    def _sums(self, b: int) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
        """Sums of one row of a bin and of two, with rows that have them."""
        of: dict[int, list[int]] = defaultdict(list)
        for i in self.bins[b]:
            of[self.size[i]].append(i)
        sizes, pairs = sorted(of), {}
        for k, x in enumerate(sizes):
            if len(of[x]) > 1:
                pairs.setdefault(2 * x, (of[x][0], of[x][1]))
            for y in sizes[:k]:
                pairs.setdefault(x + y, (of[x][0], of[y][0]))
        return {x: (of[x][0],) for x in sizes}, pairs

    def _index(self, bins: list[int]) -> None:
        """For no or one row (0) and for two rows (1): by their sum, the (room, bin) of ``bins`` in order, and the most room."""
        self.at: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
        self.most = np.zeros((2, self.cap + 1), np.int64)
        for b in bins:
            self._enter(b, True)

    def _enter(self, b: int, there: bool) -> None:
        """Put a bin into the index, or take it out."""
        entry = (self.cap - self.fill[b], b)
        if not entry[0]:
            return
        singles, pairs = self._sums(b)
        for kind, sums in enumerate(([0, *singles], pairs)):
            for x in sums:
                rooms = self.at[kind][x]
                if there:
                    bisect.insort(rooms, entry)
                else:
                    del rooms[bisect.bisect_left(rooms, entry)]
                self.most[kind, x] = rooms[-1][0] if rooms else 0

    def step(self, source: int) -> bool:
        """One change that moves fill from ``source`` to a bin of the index; False where there is none.

        A move or exchange with gain g takes fill f(target) to f + g and
        f(source) to f - g; with f(target) >= f(source) the squared sum grows.
        The largest gain is taken, and of its targets the fullest.
        """
        singles, pairs = self._sums(source)
        best = (0, 0, 0)
        # a single row is preferred to two of the same sum; two for two is not among the changes
        for kind, out in enumerate(({**pairs, **singles}, singles)):
            sums = np.array(sorted(out))
            away = np.flatnonzero(self.most[kind])
            # the largest of this bin's sums that fits once ``away`` has left
            k = np.searchsorted(sums, away + self.most[kind, away], "right") - 1
            gain = np.where(k >= 0, sums[k] - away, 0)
            if len(gain) and gain.max() > best[0]:
                j = int(gain.argmax())
                best = (int(gain[j]), kind, int(away[j]))
        gain, kind, away = best
        if not gain:
            return False
        rooms = self.at[kind][away]
        t = rooms[bisect.bisect_left(rooms, (gain, -1))][1]
        give = singles.get(gain + away) or pairs[gain + away]
        take = self._sums(t)[kind][away] if away else ()
        self._enter(t, False)
        self.bins[source] = [i for i in self.bins[source] if i not in give] + list(take)
        self.bins[t] = [i for i in self.bins[t] if i not in take] + list(give)
        self.fill[source] -= gain
        self.fill[t] += gain
        self._enter(t, True)
        return True

    def run(self) -> list[list[int]]:
        """Take the bins apart, the emptiest first, while the room left is a bin or more and anything changes.

        Returns the bins at their places, some of them empty. Within a pass the
        bins that are still to come only get fuller, so the next source is never
        fuller than a bin of the index. The squared sum bounds the changes.
        """
        changed = True
        while changed:
            changed = False
            open_bins = [b for b in range(len(self.bins)) if 0 < self.fill[b] < self.cap]
            room = self.cap * len(open_bins) - sum(self.fill[b] for b in open_bins)
            if room < self.cap:
                break  # no bin can be saved
            self._index(open_bins)
            queue = [(self.fill[b], b) for b in open_bins]
            heapq.heapify(queue)
            while queue and room >= self.cap:
                fill, source = heapq.heappop(queue)
                if fill < self.fill[source]:
                    if self.fill[source] < self.cap:
                        heapq.heappush(queue, (self.fill[source], source))
                    continue
                self._enter(source, False)
                while self.bins[source] and self.step(source):
                    changed = True
                if not self.bins[source]:
                    room -= self.cap
        return self.bins


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins (lists of rows of ``lengths``) of at most ``capacity``: best fit, then local search."""
    return [b for b in _Search(best_fit(lengths, capacity), lengths, capacity).run() if b]


def _pack_cell(cell: pd.DataFrame, first_id: int | None) -> pd.DataFrame:
    """A cell's pieces with sequences, fills and offsets; ``first_id`` is None where the pieces lie in sequences already."""
    cell = cell.sort_values(["rid"] if first_id is not None else ["sequence_id", "rid"], kind="stable").reset_index(drop=True)
    lengths = cell["length"].to_numpy()
    if first_id is not None:
        bins = best_fit(lengths, CAPACITY)
        ids = first_id + np.arange(len(bins), dtype=np.int64)
    else:
        ids, firsts = np.unique(cell["sequence_id"].to_numpy(np.int64), return_index=True)
        bins = [x.tolist() for x in np.split(np.arange(len(cell)), firsts[1:])]
    bins = _Search(bins, lengths, CAPACITY).run()
    # a sequence that stays keeps its id
    ids = ids[[k for k, b in enumerate(bins) if b]]
    bins = [b for b in bins if b]
    rows = np.concatenate([np.asarray(b, np.int64) for b in bins])
    counts = np.array([len(b) for b in bins])
    ends = np.cumsum(lengths[rows])
    starts = ends - lengths[rows]
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = cell.iloc[rows][["rid", "doc_id", "piece", "start", "length", "ids_crc32"]].copy()
    out["doc_id"] = out["doc_id"].astype("Int64")
    out["sequence_id"] = np.repeat(ids, counts)
    fills = np.add.reduceat(lengths[rows], firsts)
    out["fill"] = np.repeat(fills, counts).astype(np.int32)
    out["offset"] = starts - np.repeat(starts[firsts], counts)
    return out


def document_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of each text, then id 0, cut after every 2048.

    A NULL or empty text is the single id 0.
    """

    def cut(batches):
        import pyarrow as pa

        bpe = WordBpe(tokenizer)
        for batch in batches:
            for first, ids, counts in bpe.slices(batch.column("text")):
                # each text's ids and id 0
                sizes = counts + 1
                pieces = -(-sizes // CAPACITY)
                doc = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * CAPACITY
                length = np.minimum(sizes[doc] - start, CAPACITY)
                at = (np.cumsum(counts) - counts)[doc] + start
                last = start + length == sizes[doc]
                raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length - last).tolist())]
                crc = [zlib.crc32(_ZERO, c) if end else c for c, end in zip(crc, last.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(first + doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(cut, _PIECES)


def pack_pieces(pieces: DataFrame) -> DataFrame:
    """``pieces`` with sequence_id and offset; pieces of one sequence lie without gaps from 0.

    The first round packs cells of pieces; the next ones deal whole underfull
    sequences into other cells and search on. They end with a round of one
    cell, or when the room left is less than a sequence, or when a round
    changes nothing.
    """
    unplaced = F.lit(None).cast("long").alias("sequence_id")
    left = materialise(pieces.select("*", F.monotonically_increasing_id().alias("rid"), unplaced), "pieces")
    n, done, round_no, squares = left.count(), [], 0, None
    ids_per_cell = CELL_PIECES * 16
    while n:
        cells = max(1, math.ceil(n / CELL_PIECES))
        first = round_no == 0
        cell = F.pmod(F.xxhash64(F.lit(round_no), "rid" if first else "sequence_id"), F.lit(cells)).alias("cell")
        dealt = left.select("rid", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", cell)
        step = (lambda key, pdf: _pack_cell(pdf, int(key[0]) * ids_per_cell)) if first else (lambda key, pdf: _pack_cell(pdf, None))
        packed = materialise(dealt.groupBy("cell").applyInPandas(step, _PACKED), f"packed-{round_no}")
        # one row: the underfull sequences' pieces, sequences and tokens, and the sums of squared fills
        under = F.col("fill") < DONE_FILL
        square = F.col("fill").cast("long") * F.col("length")
        n, bins, tokens, left_squares, all_squares = packed.agg(
            F.count_if(under), F.count_if(under & (F.col("offset") == 0)), F.sum(F.when(under, F.col("length")).otherwise(0)),
            F.sum(F.when(under, square).otherwise(0)), F.sum(square),
        ).first()
        if cells == 1 or bins * CAPACITY - tokens < CAPACITY or all_squares == squares:
            done.append(packed)
            break
        done.append(packed.filter(~under))
        left, squares, round_no = packed.filter(under), left_squares, round_no + 1
    if not done:
        done = [left.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))]
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    result = done[0].select(*out)
    for d in done[1:]:
        result = result.unionByName(d.select(*out))
    return result


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows and NULL ids are pieces like others. An empty table gives an
    empty result.
    """
    return pack_pieces(document_pieces(docs, tokenizer or default_path(), id_col, text_col))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
