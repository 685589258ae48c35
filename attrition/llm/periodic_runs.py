"""Periodic runs of words, found on tiles of a scale of their own for each period octave.

A run is a longest stretch of consecutive words that are all equal to the word q places
before, q being its smallest period, with max(6, 4q) words or more.

1. A document becomes tiles.  For the periods q of an octave, P <= q < 2P, it has a
   boundary at every P-th word; eight boundaries make a tile, which reaches from P
   words before the first to 7P words after the last.  A run of that octave contains a
   boundary c with the words from c on, 2q of them, equal to those q places later.  A
   tile none of whose boundaries has 2P words that recur P to 2P - 1 places later (by
   hashes of all windows, which equal words cannot fail) has no run and isn't made.
2. Each tile is solved on its own: for each of its boundaries the Z-function of the
   words after it, and the Z-function of the words before it read backwards, give every
   period's reach to both sides; a period whose root is itself periodic is left out.
   What a tile finds is a fragment of a run, cut at the tile's ends.
3. Fragments move by document and period and are stitched: neighbours share a period or
   more, and two stretches of one period that share that many words are one stretch.

Tiles and fragments are rows of tables, so a very long text spreads over many tasks
once it has been read.  Boundaries of one tile that an earlier one's fragments cover
aren't solved again, so a text of one repeated word costs little more than others.

Defined results: a null or empty text has no words and no runs; repeated rows and null
ids keep a row each; words are compared in whole, never by hash alone; an empty table
gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attrition.llm.common import arrow_map, stored, words

LEAST_WORDS = 6
#: A run has its period this many times.
TIMES = 4
#: Boundaries of a tile.
BOUNDARIES = 8
#: Words that a task works on at a time, whole documents; a longer document is worked on alone.
GROUP_WORDS = 1 << 18
#: Words of tiles that a task solves.
TASK_WORDS = 1 << 20
#: Pairs of a boundary and a period compared at a time.
_PAIRS = 1 << 20
#: Fragments of a document and period are stitched in stretches of so many tiles first.
_STRETCH = 1 << 12

Tile = tuple[int, int, int, int, np.ndarray]


def _window_hashes(ids: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(P, hashes of the windows of 2P words from each place) for P = 1, 2, 4, …; the
    last 2P - 1 places' hashes cover zeros beyond the end."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        width, p = 1, 1
        while p <= most:
            later = np.zeros_like(h)
            later[:max(len(h) - width, 0)] = h[width:]
            h = h * np.uint64(0xBF58476D1CE4E5B9) + (later ^ (later >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(27)
            width *= 2
            yield p, h
            p *= 2


def tiles_of(ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, Tile]]:
    """(document, tile) for documents that stand one after the other in ``ids``; a tile
    is (P, place of its first word, its first boundary, bits of boundaries, ids), places
    counted from the document's start."""
    lengths = np.diff(starts)
    most = int(lengths.max(initial=0)) // TIMES
    for p, h in _window_hashes(ids, most):
        docs = np.nonzero(lengths >= max(LEAST_WORDS, TIMES * p))[0]
        # boundaries with room for a period and the 2P words after it
        each = (lengths[docs] - 3 * p) // p + 1
        doc = np.repeat(docs, each)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
        at = starts[doc] + number * p
        end = starts[doc + 1]
        hit = np.zeros(len(doc), bool)
        step = max(1, _PAIRS // p)
        for a in range(0, len(doc), step):
            c = at[a:a + step, None]
            q = np.arange(p, 2 * p)[None, :]
            other = c + q
            hit[a:a + step] = ((other + 2 * p <= end[a:a + step, None]) & (h[c] == h[np.minimum(other, len(h) - 1)])).any(axis=1)
        marked = np.nonzero(hit)[0]
        if not len(marked):
            continue
        tile, first = np.unique(np.stack([doc[marked], number[marked] // BOUNDARIES]), axis=1, return_inverse=True)
        bits = np.zeros(tile.shape[1], np.int64)
        np.bitwise_or.at(bits, first, np.int64(1) << (number[marked] % BOUNDARIES))
        for d, t, b in zip(*tile.tolist(), bits.tolist(), strict=True):
            core = t * BOUNDARIES * p
            low = max(0, core - p)
            high = min(int(lengths[d]), core + (BOUNDARIES - 1) * p + 8 * p)
            yield d, (p, low, core, b, ids[starts[d] + low:starts[d] + high])


def z_function(s: list[int], upto: int) -> list[int]:
    """For each place below ``upto`` how many words from there on equal the first ones (the first place: 0)."""
    n = len(s)
    z = [0] * min(upto, n)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve(tile: Tile) -> list[tuple[int, int, int]]:
    """(period, start, end) of the stretches around the tile's marked boundaries."""
    p, low, core, bits, words = tile
    s = words.tolist()
    found: list[tuple[int, int, int]] = []
    for c in (core + k * p - low for k in range(BOUNDARIES) if bits >> k & 1):
        # where one period of an octave is repeated three times, no other one is
        if any(a <= c and c + 3 * q <= b for q, a, b in found):
            continue
        ahead = z_function(s[c:], 2 * p)
        roots: list[int] = []
        for q in range(1, len(ahead)):
            if ahead[q] >= q and not any(q % g == 0 and ahead[g] >= q - g for g in roots):
                roots.append(q)
        periods = [q for q in roots if q >= p and ahead[q] >= 2 * p]
        if not periods:
            continue
        before = s[:c][::-1]
        behind = z_function([*before, -1, *s[:c + 2 * p][::-1]], len(before) + 1 + 2 * p)
        for q in periods:
            found.append((q, c - behind[len(before) + 1 + 2 * p - q], c + q + ahead[q]))
    return [(q, low + a, low + b) for q, a, b in found]


def _cut(key_type: pa.DataType, digests: bool) -> Callable:
    """Documents to rows: one per document, and its tiles after it."""
    schema = pa.schema([("rid", pa.int64()), ("key", key_type), ("whole", pa.string()), ("words", pa.string()), ("p", pa.int64()), ("low", pa.int64()),
                        ("core", pa.int64()), ("bits", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), count()

        def rows_of(docs: list[tuple[object, list[bytes]]]) -> Iterator[list[dict]]:
            number = defaultdict(count().__next__)
            ids = np.fromiter((number[w] for _, words in docs for w in words), np.int32)
            starts = np.cumsum([0, *(len(words) for _, words in docs)])
            names = [(part << 33) + next(made) for _ in docs]
            tiled: set[int] = set()
            out, size = [], 0
            for d, (p, low, core, bits, own) in tiles_of(ids, starts):
                tiled.add(d)
                out.append({"rid": names[d], "p": p, "low": low, "core": core, "bits": bits, "ids": own.tobytes()})
                size += own.nbytes
                if size > 8 << 20:
                    yield out
                    out, size = [], 0
            yield out
            out = []
            for d, (key, words) in enumerate(docs):
                text = b" ".join(words)
                whole = None if d in tiled else hashlib.sha256(text).hexdigest() if digests else text.decode()
                out.append({"rid": names[d], "key": key, "whole": whole, "words": text.decode() if d in tiled else None})
            yield out

        docs: list[tuple[object, list[bytes]]] = []
        n = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                docs.append((key, (text or b"").split()))  # parts at exactly the six ASCII blanks
                n += len(docs[-1][1])
                if n >= GROUP_WORDS:
                    yield from (pa.RecordBatch.from_pylist(rows, schema=schema) for rows in rows_of(docs))
                    docs, n = [], 0
        yield from (pa.RecordBatch.from_pylist(rows, schema=schema) for rows in rows_of(docs))

    return run


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rid", pa.int64()), ("q", pa.int64()), ("stretch", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        out = []
        for rid, p, low, core, bits, ids in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            stretch = core // (BOUNDARIES * p * _STRETCH)
            out += [(rid, q, stretch, a, b) for q, a, b in solve((p, low, core, bits, np.frombuffer(ids, np.int32)))]
        columns = list(zip(*out, strict=True)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)


def _stitch(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments of one period that share a period's words or more become one."""
    order = Window.partitionBy(*keys).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("a") + F.col("q") > reach), 1).otherwise(0)
    numbered = fragments.withColumn("new", new).withColumn("stitch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "stitch").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("stitch")


RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


def _collapse(digests: bool) -> Callable:
    """Drops the words that a run repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, text, runs = (batch.column(c)[i].as_py() for c in range(3))
                words = text.split(" ")
                change = np.zeros(len(words) + 1, np.int64)
                for r in runs or ():
                    change[r["start"] + r["period"]] += 1
                    change[r["start"] + r["length"]] -= 1
                kept = " ".join(w for w, gone in zip(words, np.cumsum(change).tolist()) if not gone)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([hashlib.sha256(kept.encode()).hexdigest() if digests else kept]),
                                                  batch.column(2).slice(i, 1)], names=["key", "text", "runs"])

    return run


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", digests: bool = False) -> DataFrame:
    """(key, text, runs): one row per document with its runs by start, then period, and
    its words, joined by one space, without those that a run contains after its first
    period; with ``digests`` the SHA-256 of that text instead."""
    kind = docs.schema[key].dataType
    name = kind.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    cut = stored(arrow_map(rows, _cut(to_arrow_type(kind), digests),
                           f"rid bigint, key {name}, whole string, words string, p bigint, low bigint, core bigint, bits bigint, ids binary"), "runs-tiles")
    tiles = cut.where("p IS NOT NULL").select("rid", "p", "low", "core", "bits", "ids")
    # by words: a tile of 16 P words takes its time by them
    tasks = (tiles.agg(F.sum("p")).first()[0] or 0) * 2 * BOUNDARIES // TASK_WORDS + 1
    tiles = tiles.repartition(tasks, "rid", "p", "core")
    fragments = arrow_map(tiles, _fragments, "rid bigint, q bigint, stretch bigint, a bigint, b bigint")
    runs = _stitch(_stitch(fragments, ["rid", "q", "stretch"]).drop("stretch"), ["rid", "q"]).where(
        (F.col("b") - F.col("a") >= LEAST_WORDS) & (F.col("b") - F.col("a") >= TIMES * F.col("q")))
    own = runs.groupBy("rid").agg(F.sort_array(F.collect_list(
        F.struct(F.col("a").alias("start"), F.col("q").alias("period"), (F.col("b") - F.col("a")).alias("length")))).alias("runs"))
    tiled = cut.where("words IS NOT NULL").select("rid", "key", "words").join(own, "rid", "left").select("key", "words", "runs")
    collapsed = arrow_map(tiled, _collapse(digests), f"key {name}, text string, runs {RUNS}")
    plain = cut.where("whole IS NOT NULL").select("key", F.col("whole").alias("text"), F.lit(None).cast(RUNS).alias("runs"))
    return collapsed.unionByName(plain).select("key", "text", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))


def longest(runs: Column) -> Column:
    """The run with the greatest length by period, compared by cross products; then the
    smallest start, then period.  ``runs`` stand in that order, so the first one stays."""
    none = F.lit(None).cast("struct<start:bigint,period:bigint,length:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def looped(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text): a tenth of the documents with an end that repeats itself: h being
    the crc32 of the id and g its tenth, where h % 10 is 0 each word i >= a becomes word
    a + (i - a) % p, with a = g % n and p = 1 + (n - a) // (3 + g % 8) for n words."""
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    base = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias(text), h.alias("h"))
    w = F.when(F.col("h") % 10 == 0, words(F.col(text)))
    base = base.select("*", w.alias("w")).select("*", F.expr("h div 10").alias("g"), F.size("w").cast("long").alias("n"))
    base = base.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    base = base.select("*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    place = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(
        F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return base.select(key, F.when(F.col("n") > 0, F.array_join(place, " ")).otherwise(F.col(text)).alias(text))


def runs_table(docs: DataFrame) -> DataFrame:
    """One row per document: its runs' number, the greatest one and two digests."""
    found = periodic_runs(looped(docs.select("doc_id", "text")), digests=True)
    best = found.select("*", longest(F.col("runs")).alias("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return best.select(
        F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.col("text").alias("collapsed_sha256"))
