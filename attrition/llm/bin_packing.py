"""Packing token pieces into sequences with a grouping genetic algorithm.

Documents are tokenised where they are read; only piece lengths and digests go
on.  Pieces of the full length are sequences of their own.  The rest are dealt
by a hash of their row number over shards of about ``SHARD_PIECES`` pieces, and
each shard is evolved by ``ISLANDS`` islands, each a population of packings.

A gene is a whole bin.  Crossover injects the best-filled bins of one parent
into the other, removes the other's bins that hold any of the same pieces, and
puts the displaced pieces back by best fit, longest first.  Mutation empties a
few poorly filled bins in the same way.  After each epoch every island's best
packing migrates to the next island of its shard; populations are rows of a
table in the shared folder, so a lost executor costs one epoch of its shards.
A shard stops once it reaches the bound ceil(total length / capacity).

Defined results: a null text is empty and packs its end token alone; empty
texts likewise; very long texts are cut into full pieces after a first shorter
one; repeated rows are packed as often as they occur; null ids are kept; an empty
table gives an empty result."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import arrow_map, stored
from attrition.llm.tokenization import END_ID, VOCABULARY, load_tokenizer

CAPACITY = 2048
SHARD_PIECES = 16384
ISLANDS = 2
POPULATION = 6
GENERATIONS = 4
EPOCHS = 2


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY,
           vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """(key, row, piece, start, length, ids_crc32) of every document, end token included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tok, number = TaskContext.get().partitionId(), load_tokenizer(vocabulary), count()
        for batch in batches:
            rows, out = [], ([], [], [], [], [])
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = np.append(tok.ids(t or ""), np.uint32(end_id)).astype("<u4")
                for p, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append(i)
                    for o, v in zip(out, ((part << 36) + next(number), p, start, length,
                                          zlib.crc32(ids[start:start + length].tobytes())), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                 *[pa.array(o, pa.int64()) for o in out[2:]]], names=["key", "row", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")), run, f"key {kind}, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


Packing = list[list[int]]  # bins of piece numbers


def best_fit(lengths: list[int], bins: Packing, loose: list[int], capacity: int, rng: np.random.Generator | None = None) -> Packing:
    """``bins`` with the loose pieces added, longest first (with ``rng``: roughly so),
    each into the fullest bin that has room."""
    order = [lengths[i] for i in loose] if rng is None else (np.array([lengths[i] for i in loose]) * rng.uniform(0.5, 1.0, len(loose))).tolist()
    out = [list(b) for b in bins]
    room = sorted((capacity - sum(lengths[i] for i in b), n) for n, b in enumerate(out))
    for _, i in sorted(zip(order, loose, strict=True), key=lambda x: (-x[0], x[1])):
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, n = room.pop(at)
        else:
            left, n = capacity, len(out)
            out.append([])
        out[n].append(i)
        insort(room, (left - lengths[i], n))
    return out


def fitness(lengths: list[int], bins: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, fuller full bins (mean squared fill)."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(lengths: list[int], giver: Packing, taker: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """Inject the giver's best-filled bins into the taker."""
    by_fill = sorted(giver, key=lambda b: -sum(lengths[i] for i in b))
    injected = by_fill[:max(1, int(len(by_fill) * rng.uniform(0.2, 0.6)))]
    own = {i for b in injected for i in b}
    kept, loose = [], []
    for b in taker:
        if own.isdisjoint(b):
            kept.append(b)
        else:
            loose += [i for i in b if i not in own]
    return best_fit(lengths, [*injected, *kept], loose, capacity)


def mutate(lengths: list[int], bins: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """Empty the worst-filled bins and a few others, and fit their pieces again in a
    slightly different order."""
    by_fill = sorted(range(len(bins)), key=lambda n: sum(lengths[i] for i in bins[n]))
    gone = set(by_fill[:2]) | set(rng.integers(0, len(bins), 3).tolist())
    return best_fit(lengths, [b for n, b in enumerate(bins) if n not in gone], [i for n in gone for i in bins[n]], capacity, rng)


def evolve(lengths: list[int], population: list[Packing], capacity: int, generations: int, rng: np.random.Generator) -> list[Packing]:
    """The population after some generations, best first."""
    bound = -(-sum(lengths) // capacity)
    ranked = sorted(population, key=lambda b: fitness(lengths, b, capacity), reverse=True)
    for _ in range(generations):
        if len(ranked[0]) <= bound or len(ranked) < 2:
            break
        children = []
        for _ in range(len(ranked) - 1):
            a, b = sorted(rng.choice(len(ranked), 2, replace=False).tolist())
            child = crossover(lengths, ranked[a], ranked[b], capacity, rng)
            children.append(mutate(lengths, child, capacity, rng) if rng.random() < 0.5 else child)
        ranked = sorted([*ranked, *children], key=lambda b: fitness(lengths, b, capacity), reverse=True)[:len(ranked)]
    return ranked


def first_population(lengths: list[int], size: int, capacity: int, rng: np.random.Generator) -> list[Packing]:
    """Best-fit decreasing, then best fit after random bins are broken up; one
    member is enough where the bound is reached at once."""
    first = best_fit(lengths, [], list(range(len(lengths))), capacity)
    out = [first]
    if len(first) > -(-sum(lengths) // capacity):
        for _ in range(size - 1):
            keep = [b for b in first if rng.random() < 0.7]
            inside = {i for b in keep for i in b}
            loose = [i for i in range(len(lengths)) if i not in inside]
            # pairs of loose pieces start out together, so that members differ
            rng.shuffle(loose)
            seeds = [[a, b] for a, b in zip(loose[::6], loose[1::6], strict=False) if lengths[a] + lengths[b] <= capacity]
            used = {i for s in seeds for i in s}
            out.append(best_fit(lengths, [*keep, *seeds], [i for i in loose if i not in used], capacity))
    return out


def _pack_up(population: list[Packing], n: int) -> bytes:
    """Each member as the bin number of every piece."""
    out = np.empty((len(population), n), dtype="<i4")
    for m, bins in enumerate(population):
        for b, members in enumerate(bins):
            out[m, members] = b
    return out.tobytes()


def _unpack(blob: bytes, n: int) -> list[Packing]:
    out = []
    for row in np.frombuffer(blob, "<i4").reshape(-1, n) if n else []:
        bins: Packing = [[] for _ in range(int(row.max()) + 1)]
        for i, b in enumerate(row.tolist()):
            bins[b].append(i)
        out.append(bins)
    return out


_STATE = "shard bigint, island int, lengths binary, members binary, elite binary"


def _settle(shard: int, island: int, lengths: list[int], population: list[Packing]) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "island": [island], "lengths": [np.array(lengths, "<i4").tobytes()],
                         "members": [_pack_up(population, len(lengths))], "elite": [_pack_up(population[:1], len(lengths))]})


def pack(loose: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS,
         population: int = POPULATION, generations: int = GENERATIONS, epochs: int = EPOCHS) -> DataFrame:
    """(row, shard, bin, offset) for each piece of ``loose`` (columns row, length);
    ``row`` is unique."""
    n = loose.count()
    shards = max(1, -(-n // shard_pieces))
    dealt = loose.select("row", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    # by shards: a shard's lengths are few bytes and much work
    dealt = dealt.repartition(shards, "shard")

    def seed(shard: int, island: int, epoch: int) -> np.random.Generator:
        return np.random.default_rng([shard, island, epoch])

    def begin(rows: pd.DataFrame) -> pd.DataFrame:
        """A shard's islands, from its lengths in the order of its rows."""
        shard = int(rows["shard"].iloc[0])
        lengths = rows.sort_values("row")["length"].astype(int).tolist()
        return pd.concat([_settle(shard, k, lengths, evolve(
            lengths, first_population(lengths, population, capacity, seed(shard, k, 0)), capacity, generations, seed(shard, k, 1)))
            for k in range(islands)])

    def epoch_of(number: int):
        def step(rows: pd.DataFrame) -> pd.DataFrame:
            r = rows.iloc[0]
            lengths = np.frombuffer(r["lengths"], "<i4").tolist()
            own = _unpack(r["members"], len(lengths))
            guest = _unpack(r["guest"], len(lengths)) if r["guest"] is not None else []
            size = max(len(own), 1)
            ranked = evolve(lengths, own + guest, capacity, generations, seed(int(r["shard"]), int(r["island"]), number + 2))
            return _settle(int(r["shard"]), int(r["island"]), lengths, ranked[:size])
        return step

    state = stored(dealt.groupBy("shard").applyInPandas(begin, _STATE), "packing-islands")
    for number in range(epochs):
        guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
        both = state.join(guests, ["shard", "island"]).repartition(shards * islands, "shard", "island")
        state = stored(both.groupBy("shard", "island").applyInPandas(epoch_of(number), _STATE), "packing-islands")

    def place(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The best island's packing, as a place for every row."""
        rows = rows.sort_values("row")
        lengths = rows["length"].astype(int).tolist()
        best = max((_unpack(e, len(lengths))[0] for e in found.sort_values("island")["elite"]), key=lambda b: fitness(lengths, b, capacity))
        bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for b, members in enumerate(best):
            at = 0
            for i in members:
                bin_of[i], offset[i] = b, at
                at += lengths[i]
        return pd.DataFrame({"row": rows["row"], "shard": rows["shard"], "bin": bin_of, "offset": offset})

    return dealt.groupBy("shard").cogroup(state.select("shard", "island", "elite").groupBy("shard")).applyInPandas(
        place, "row bigint, shard bigint, bin bigint, offset bigint")


def packed_table(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, **options) -> DataFrame:
    """One row per piece: (key, piece, start, length, ids_crc32, sequence_id, offset)."""
    cuts = stored(pieces(docs, text, key, capacity), "packing-pieces")
    full = cuts.where(F.col("length") == capacity)
    loose = cuts.where(F.col("length") < capacity)
    placed = pack(loose.select("row", "length"), capacity, **options)
    common = ["key", "piece", "start", "length", "ids_crc32"]
    return full.select(*common, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(
        loose.join(placed, "row").select(*common, (F.col("shard") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset"))
