"""Phrase collocations: Misra-Gries candidates, then exact counts.

1. Every run of one to five words of a piece has a 64-bit key. The key's leading bits
   name its hash partition; tasks send, per partition, the sorted distinct keys of a
   buffer with their counts.
2. A hash partition folds these into one Misra-Gries summary whose capacity exceeds
   the partition's mass divided by the least count. What a summary takes off a counter is then
   less than the least count, so every frequent run survives; so do a few others. The
   summary is the only state: memory does not grow with the number of distinct runs.
   A hot run is one entry a buffer, and languages are part of the key.
3. The second pass counts the survivors' runs exactly, by their words: equal keys are
   compared word by word in a task, tasks send their sums by hash partition, one row each,
   and a partition adds them up by spelling. Survivors are
   broadcast in portions of at most ``PORTION`` keys; each portion is one reading of the texts.
4. Scores come from joins of the counts with themselves, in exact integers.

Defined results: NULL text is empty, NULL lang is ``und``. A text without words, and an
empty table, give no rows. Repeated rows count as often as they occur. A very long text
is taken apart alone (about 100 bytes of memory for each of its words). Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraudscope.llm.common import materialise, table
from fraudscope.llm.phrase_words import Words, slices

#: Keys sorted at a time in a task (32 MB).
BUFFER = 1 << 22
#: Bytes of text for each hash partition, and the fewest partitions (a power of 2 is taken).
PARTITION_BYTES, LEAST_PARTITIONS = 1 << 25, 64
#: Bits of a key beside those of its partition.
REST_BITS = 32
#: Survivors broadcast at a time (8 bytes each, and as many for a table that rules most runs out).
PORTION = 1 << 22
#: Counted runs held in a task before they are added up and sent on.
HELD_RUNS = 1 << 20
#: Parts in which a language's best are picked first.
PARTS = 64

_SENT = "part int, mass long, keys binary, counts binary, many binary"
_COUNTED = "part int, lang array<string>, m array<int>, phrase array<string>, n array<long>"


def _packed(keys: np.ndarray, counts: np.ndarray):
    """Sorted keys and counts of one partition as three byte strings (counts above 255 apart)."""
    many = np.flatnonzero(counts >= 255)
    return keys.astype("<u4").tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), np.stack([many, counts[many]]).astype("<i8").tobytes()


def _unpacked(keys: bytes, counts: bytes, many: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(counts, np.uint8).astype(np.int64)
    at, true = np.frombuffer(many, "<i8").reshape(2, -1)
    n[at] = true
    return np.frombuffer(keys, "<u4"), n


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, counts)."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _send(bits: int, longest: int):
    """First pass: distinct keys and counts by hash partition."""

    def flush(held):
        import pyarrow as pa

        keys, counts = distinct(np.concatenate(held) >> np.uint64(64 - REST_BITS - bits))
        part = (keys >> np.uint64(REST_BITS)).astype(np.int64)
        there = np.unique(part)
        ends = np.searchsorted(part, np.append(there, 1 << bits))
        rows = [(int(p), int(counts[a:b].sum()), *_packed(keys[a:b] & np.uint64((1 << REST_BITS) - 1), counts[a:b])) for p, a, b in zip(there, ends, ends[1:])]
        for i in range(0, len(rows), 64):
            cols = list(zip(*rows[i : i + 64]))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["part", "mass", "keys", "counts", "many"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for words, _ in slices(batch.column("text"), batch.column("lang")):
                for _, _, keys in words.keys(longest):
                    held.append(keys)
                    size += len(keys)
                if size >= BUFFER:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


class MisraGries:
    """A mergeable summary of counts: at most ``capacity`` counters, each less than its true count by ``error`` at most.

    Taking the (capacity + 1)th largest count off all counters takes that much off more
    than ``capacity`` of them, so error <= mass / (capacity + 1).
    """

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        """Add the counters of another summary, or true counts (error 0); its keys are distinct."""
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        both, n = both[order], np.concatenate([self.counts, counts])[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        self.keys, self.counts = both[first], np.add.reduceat(n, first) if len(both) else n
        self.error += error
        if len(self.keys) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            off = int(np.partition(self.counts, at)[at])
            self.error += off
            left = self.counts > off
            self.keys, self.counts = self.keys[left], self.counts[left] - off

    def at_least(self, least: int) -> np.ndarray:
        """Keys whose true count may reach ``least``."""
        return self.keys[self.counts + self.error >= least]


def _summarise(least: int):
    """Rows of a partition, sorted by hash partition, to the survivors of each hash partition."""

    def run(batches):
        import pyarrow as pa

        part, summary, held = None, None, []

        def done():
            keys = summary.at_least(least).astype("<u4")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary())], names=["part", "n", "keys"])

        def fold():
            if held:
                keys = np.concatenate([k for k, _ in held])
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], np.concatenate([c for _, c in held])[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                summary.merge(keys[first], np.add.reduceat(n, first))
                held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                p = batch.column("part")[i].as_py()
                if p != part:
                    if part is not None:
                        fold()
                        yield done()
                    part, summary = p, MisraGries(batch.column("whole")[i].as_py() // least + 1)
                held.append(_unpacked(*(batch.column(c)[i].as_py() for c in ("keys", "counts", "many"))))
                if sum(len(k) for k, _ in held) >= max(1 << 16, summary.capacity):
                    fold()
        if part is not None:
            fold()
            yield done()

    return run


def survivors(texts: DataFrame, bits: int, longest: int, least: int) -> DataFrame:
    """(part, n, keys): per hash partition the keys whose count may reach ``least``."""
    sent = texts.mapInArrow(_send(bits, longest), _SENT)
    whole = sent.withColumn("whole", F.sum("mass").over(Window.partitionBy("part")))
    return whole.select("part", "whole", "keys", "counts", "many").mapInArrow(_summarise(least), "part int, n long, keys binary")


class _Members:
    """Whether keys are among those of a sorted array; a table of bytes rules most others out."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        size = 1 << max(10, int(8 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.seen = np.zeros(size, bool)
        self.seen[keys & self.mask] = True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that are members."""
        at = np.flatnonzero(self.seen[keys & self.mask])
        if not len(at) or not len(self.keys):
            return at[:0]
        k = keys[at]
        return at[self.keys[np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)] == k]


def _same(words: Words, m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the runs of m words at ``a`` and at ``b`` are the same words of the same language."""
    same = words.lang[a] == words.lang[b]
    for j in range(m):
        same &= words.word[a + j] == words.word[b + j]
    return same


def exact_groups(words: Words, m: int, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one place, count, key) of each distinct run of m words among those at ``at``; the keys, a function of the runs, only speed it up."""
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    if not (_same(words, m, at[1:], at[:-1]) | new[1:]).all():  # different runs of one key: sort by the words
        order = np.lexsort([words.lang[at], *[words.word[at + j] for j in range(m)]])
        at, keys = at[order], keys[order]
        new = np.concatenate([[True], ~_same(words, m, at[1:], at[:-1])])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), keys[first]


def _added_up(tables, by: list[str]):
    """Tables of counted runs as one, equal runs added up."""
    import pyarrow as pa

    return pa.concat_tables(tables).group_by(by).aggregate([("n", "sum")]).rename_columns([*by, "n"])


def _count(wanted, bits: int, longest: int, with_totals: bool):
    """Second pass: exact counts of the wanted runs by spelling (m = 0: all words of the language), a row for each hash partition."""
    runs = ["part", "lang", "m", "phrase"]

    def send(held):
        import pyarrow as pa

        whole = _added_up(held, runs).sort_by("part").combine_chunks()
        parts, first = np.unique(whole.column("part").to_numpy(), return_index=True)
        for i in range(0, len(parts), 64):  # 64 rows a batch
            own = first[i : i + 65]
            ends = np.append(own, len(whole)) if i + 64 >= len(parts) else own
            lists = [pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), whole.column(c).slice(ends[0], ends[-1] - ends[0]).combine_chunks()) for c in ("lang", "m", "phrase", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(parts[i : i + 64].astype(np.int32)), *lists], names=[*runs, "n"])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        members, held, size = _Members(wanted.value), [], 0
        for batch in batches:
            for words, langs in slices(batch.column("text"), batch.column("lang")):
                called = pa.array(langs, pa.string())
                if with_totals:
                    total, zero = np.bincount(words.lang, minlength=len(langs)).astype(np.int64), np.zeros(len(langs), np.int32)
                    held.append(pa.table([pa.array(zero), called, pa.array(zero), pa.array([""] * len(langs), pa.string()), pa.array(total)], names=[*runs, "n"]))
                for m, at, keys in words.keys(longest):
                    short = keys >> np.uint64(64 - REST_BITS - bits)
                    own = members.find(short)
                    if not len(own):
                        continue
                    place, n, part = exact_groups(words, m, at[own], short[own])
                    spelled = [words.spelling.take(pa.array(words.word[place + j])) for j in range(m)]
                    spelled = pc.binary_join_element_wise(*spelled, pa.scalar(b" ", pa.large_binary())) if m > 1 else spelled[0]
                    held.append(pa.table(
                        [pa.array((part >> np.uint64(REST_BITS)).astype(np.int32)), called.take(pa.array(words.lang[place])), pa.array(np.full(len(place), m, np.int32)),
                         spelled.cast(pa.large_string()).cast(pa.string()), pa.array(n.astype(np.int64))], names=[*runs, "n"]
                    ))
                    size += len(place)
                if size >= HELD_RUNS:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return run


def _add_up(least: int):
    """Rows of a partition, sorted by hash partition, to the runs that occur ``least`` times or more (and m = 0)."""
    names = ["lang", "m", "phrase", "n"]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        part, held, size = None, [], 0

        def done():
            whole = _added_up(held, names[:3])
            keep = pc.if_else(pc.equal(whole.column("m"), 0), pc.greater(whole.column("n"), 0), pc.greater_equal(whole.column("n"), least))
            yield from whole.filter(keep).to_batches(max_chunksize=1 << 16)

        for batch in batches:
            for i in range(batch.num_rows):
                p = batch.column("part")[i].as_py()
                if p != part and held:
                    yield from done()
                    held, size = [], 0
                part = p
                held.append(pa.table([batch.column(c)[i].values for c in names], names=names))
                size += len(held[-1])
                if size >= 2 * HELD_RUNS and len(held) > 1:
                    held = [_added_up(held, names[:3])]
                    size = len(held[0])
        if held:
            yield from done()

    return run


def _portions(kept: DataFrame) -> list[list[int]]:
    """Hash partitions in groups of about ``PORTION`` survivors."""
    out, size = [[]], 0
    for r in kept.select("part", "n").orderBy("part").collect():  # two numbers a hash partition
        if size and size + r.n > PORTION:
            out, size = [*out, []], 0
        out[-1].append(r.part)
        size += r.n
    return out


def phrase_counts(docs: DataFrame, text_col: str, lang_col: str, longest: int, least: int) -> DataFrame:
    """(lang, m, phrase, n): every run of up to ``longest`` words that occurs ``least`` times or more, and m = 0: all words."""
    text, lang = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    texts = docs.select(text.alias("text"), lang.alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_PARTITIONS, size // PARTITION_BYTES + 1).bit_length() - 1
    kept = materialise(survivors(texts, bits, longest, least), "phrase-survivors")
    spark, counts = docs.sparkSession, None
    for i, parts in enumerate(_portions(kept)):
        rows = kept.filter(F.col("part").between(parts[0], parts[-1])).collect() if parts else []  # PORTION keys, or one hash partition's
        keys = [np.frombuffer(r.keys, "<u4").astype(np.uint64) | np.uint64(r.part << REST_BITS) for r in rows]
        wanted = spark.sparkContext.broadcast(np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64))
        found = texts.mapInArrow(_count(wanted, bits, longest, i == 0), _COUNTED).repartition(1 << bits, "part").sortWithinPartitions("part")
        found = materialise(found.mapInArrow(_add_up(least), "lang string, m int, phrase string, n long"), f"phrase-counts-{i}")
        counts = found if counts is None else counts.unionByName(found)
    return counts


def _words(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def collocations(counts: DataFrame, share: int = 100) -> DataFrame:
    """Scored candidates (lang, phrase, a, l, r, n, score, k) from ``phrase_counts``.

    A candidate inside a longer one whose count is ``share`` % of its own or more is left
    out; looking one word further is enough, since what lies between occurs at least as often.
    """
    phrases = counts.filter("m >= 1").select("lang", "m", "phrase", F.col("n").alias("a"))
    totals = counts.filter("m = 0").select("lang", "n")
    found = phrases.filter("m >= 2").withColumn("words", F.split("phrase", " "))
    inner = F.explode(F.array(_words(1, F.col("m") - 1), _words(2, F.col("m") - 1)))
    longer = found.filter("m >= 3").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    found = found.join(longer, ["lang", "phrase"], "left").filter(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * share)).drop("outer")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(1, F.col("k")).alias("left"), _words(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    one, two = (phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(c)) for side, c in (("left", "l"), ("right", "r")))
    cuts = cuts.join(one, ["lang", "left"]).join(two, ["lang", "right"]).join(totals, "lang")
    big = "CAST({} AS DECIMAL(19,0))"  # products of two fit 38 digits; the score is 10 x n at most
    score = F.expr(f"CAST(1000 * {big.format('a')} * {big.format('n')} AS DECIMAL(38,0)) div CAST({big.format('l')} * {big.format('r')} AS DECIMAL(38,0))")
    cuts = cuts.withColumn("score", score)
    worst = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(worst).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "cut.k")


def best_by_lang(scored: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language with their rank: picked in parts, then among the parts' best."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most).drop("part")


#: Longest candidate in words, least count of a candidate, and rows reported for each language.
LONGEST, LEAST, REPORTED = 5, 100, 2000


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest phrases of two to five words that occur 100 times or more."""
    counts = phrase_counts(table(spark, sf_dir, "documents"), "text", "lang", LONGEST, LEAST)
    best = best_by_lang(collocations(counts), REPORTED)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Every run of words counted, from the definition.
OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
runs AS (
  SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))) AS phrase
  FROM w, range(1, 6) AS t(m) WHERE len(words) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM runs GROUP BY lang, m, phrase HAVING count(*) >= 100),
cand AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE m >= 2),
alone AS (
  SELECT * FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM cand g WHERE g.lang = c.lang AND g.m > c.m AND 100 * g.a >= 100 * c.a AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, t.n, CAST((1000 * c.a::HUGEINT * t.n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM alone) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[k + 1:], ' ')
  JOIN totals t ON t.lang = c.lang),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
