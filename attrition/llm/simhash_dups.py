"""SimHash near-duplicates through an inverted index of byte positions.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of
its word shingles.  Two fingerprints at ``MAX_BITS`` = 2 or fewer differing
bits share at least 6 of their 8 positional bytes (position, value).

A posting list of one positional byte holds 1/256 of all fingerprints, and its
pairs grow with the square of the corpus.  The index therefore posts four
positional bytes at a time: the 14 sets of four positions whose numbers XOR to
zero (a Steiner system: any three positions lie in exactly one set).  A pair is
tallied by aggregation over the postings it meets in.  Two fingerprints that
differ in at most two bytes meet in at least 3 postings; with three differing bytes
it is exactly one, with four at most one, beyond that none.  So the tally alone
tells 6 or more shared bytes from fewer: pairs that reach the minimum of 3 are
kept, and their differing bits are counted.

Postings of more than ``MAX_POSTING`` fingerprints (groups of near copies) emit
no pairs.  Each fingerprint of such a posting emits itself and its 64 one-bit
variants; two fingerprints at distance 2 or less always share one, and all that
share one are at distance 2 or less, so linking each to the smallest of them
keeps every connection, in rows linear in the number of fingerprints.

Equal fingerprints are one node, so exact copies cost one row.

Defined results: a null text and a text without words have fingerprint zero,
which links like any other; fewer words than a shingle form one shingle; a null
id takes the component of its links and is never the smallest; repeated rows
stay; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import arrow_map, byte_words, free_name, stored
from attrition.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Larger postings are linked through one-bit variants, which is just as exact.
MAX_POSTING = 32
#: The positions of the bytes that are posted together.
POSTED = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned 64-bit number."""
    w = byte_words(text or b"")
    if not w:
        return 0
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    digest = xxhash.xxh64_intdigest
    grams = zip(*(w[i:] for i in range(shingle)), strict=False)
    h = np.array([digest(b" ".join(g), SEED) for g in grams], dtype="<u8")
    # how often each byte value stands at each of the 8 positions, then bits per value
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BYTE_BITS).reshape(64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), run, f"key {kind}, fp bigint")


def min_meetings(differing: int) -> int:
    """Postings that two fingerprints share at least if ``differing`` of their bytes differ."""
    return min(sum(not set(t) & set(p) for p in POSTED) for t in combinations(range(8), differing))


def _postings(fp: Column) -> Column:
    def mask(positions: tuple) -> int:
        m = sum(0xFF << (8 * i) for i in positions)
        return m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*[F.struct(F.lit(n).alias("way"), fp.bitwiseAND(F.lit(mask(p)).cast("long")).alias("value")) for n, p in enumerate(POSTED)])


def tally(postings: DataFrame) -> DataFrame:
    """(a, b, meetings) of the pairs that meet in ``postings`` (fp, way, value)."""
    return (postings.withColumnRenamed("fp", "a").join(postings.withColumnRenamed("fp", "b"), ["way", "value"])
            .where("a > b").groupBy("a", "b").agg(F.count("*").alias("meetings")))


def links(fps: DataFrame, max_bits: int = MAX_BITS, max_posting: int = MAX_POSTING) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``); together they
    connect exactly what pairs within ``max_bits`` ≤ 2 connect."""
    if max_bits not in (0, 2):
        raise ValueError("max_bits is 2, or 0 for equal fingerprints only")
    fp = F.col("fp")
    index = fps.select("fp", F.explode(_postings(fp)).alias("p")).select("fp", "p.way", "p.value")
    sizes = index.groupBy("way", "value").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(index.join(sizes, ["way", "value"]), "simhash-postings")
    # a pair that also meets in a longer posting may miss the minimum here; the variants link it
    pairs = (tally(met.where(F.col("n") <= max_posting).select("fp", "way", "value"))
             .where(F.col("meetings") >= min_meetings(max_bits))
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b"))
    hot = met.where(F.col("n") > max_posting).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64 if max_bits else 0)])
    variants = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    least = variants.groupBy("variant").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("variant", "b")
    stars = (variants.join(least, "variant").where("fp <> b").select(F.col("fp").alias("a"), "b")
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fingerprint, component_id) per row of ``docs``; the component's id is
    its smallest key.  The result reads tables in the shared folder."""
    prints = stored(fingerprints(docs, text, key, shingle), "simhash-fp")
    nodes = stored(prints.groupBy("fp").agg(F.min("key").alias("first")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), max_bits))
    linked = stored(roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "first"), "simhash-roots")
    named = linked.groupBy("root").agg(F.min("first").alias("component_id")).join(linked.select("node", "root"), "root")
    alone = nodes.join(named.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    label = stored(named.select(F.col("node").alias("fp"), "component_id").unionByName(alone), "simhash-labels")
    return prints.join(label, "fp").select("key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                     max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without near-duplicates, columns unchanged: of each component the
    row with the smallest key stays (null keys come last; rows that share the
    key are told apart by a hash of all columns; of fully equal rows one stays)."""
    k, n = free_name(docs, "__key"), free_name(docs, "__copies")
    cols = [F.col(f"`{x}`") for x in docs.columns]
    ident = F.struct(F.col(f"`{key}`").isNull().alias("last"), F.col(f"`{key}`").alias("id"), F.xxhash64(*cols).alias("row"))
    groups = near_duplicates(docs.select(ident.alias("k"), F.col(f"`{text}`").alias("t")), "t", "k", shingle, max_bits)
    chosen = groups.where(F.col("key") == F.col("component_id")).groupBy(F.col("key").alias(k)).agg(F.count("*").alias(n))
    marked = docs.select(*cols, ident.alias(f"{k}_"))
    first = marked.join(chosen, F.col(f"{k}_") == F.col(k))
    once = first.where(F.col(n) == 1).select(*cols)
    repeated = first.where(F.col(n) > 1).select(*cols).distinct()
    return once.unionByName(repeated)
