"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of up to ``CHUNK_BYTES`` is encoded as it is.  A longer one is cut into
chunks that overlap by ``OVERLAP_BYTES``; chunks are rows, so one huge document
is encoded by many tasks.  Each chunk reports its number of tokens and, inside
its overlaps, its stable boundaries with their token numbers.

A boundary is stable where a character that is not white space is followed by a
space or line feed: no alternative of the byte-level pattern passes from
non-space to space, so every encoding, whatever precedes or follows, has a token
boundary there, and the tokens after it depend on the text after it alone.
Neighbouring chunks are spliced at their first common stable boundary with the
same token after it.  A document with a seam without such a boundary goes
through the next round with ``WIDEN`` times the overlap (and longer chunks);
the last round possible encodes it whole.

Defined results: a null text is empty and has 0 bytes and 0 tokens; repeated rows
keep a row each; null ids stay; an empty table gives an empty result.  Libraries
whose tokens aren't byte-level (sentencepiece, word vocabularies) encode every
text whole."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import arrow_map, stored
from attrition.llm.tokenization import VOCABULARY, load_tokenizer

CHUNK_BYTES = 1 << 16
OVERLAP_BYTES = 1 << 10
WIDEN = 8
LIMIT = 512


def cut_points(data: bytes, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Byte ranges of the chunks, at character starts; each shares ``overlap``
    bytes (or a few more) with the next."""
    def at_char(p: int) -> int:
        while p < len(data) and data[p] & 0xC0 == 0x80:
            p += 1
        return min(p, len(data))

    starts = [at_char(p) for p in range(0, max(len(data) - overlap, 1), chunk)]
    return [(s, at_char(s + chunk + overlap) if n + 1 < len(starts) else len(data)) for n, s in enumerate(starts)]


def stable_starts(data: bytes, token_starts: np.ndarray, low: int, high: int) -> np.ndarray:
    """Numbers of the tokens that start in [low, high) at a stable boundary."""
    inside = np.nonzero((token_starts >= max(low, 1)) & (token_starts < high))[0]
    raw = np.frombuffer(data, np.uint8)
    here, before = raw[token_starts[inside]], raw[token_starts[inside] - 1]
    # before: a letter, digit or mark of ASCII; other scripts' white space can't be among them
    return inside[((here == 0x20) | (here == 0x0A)) & (before > 0x20) & (before < 0x7F)]


def _count_short(rows: DataFrame, vocabulary: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(vocabulary)
        for batch in batches:
            n = pa.array([len(tok.ids(t)) if t else 0 for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["key", "n_bytes", "n_tokens"])

    return arrow_map(rows.select("key", "n_bytes", "text"), run, f"key {kind}, n_bytes bigint, n_tokens bigint")


def _number_rows(rows: DataFrame, kind: str) -> DataFrame:
    """Long texts with a number that is theirs alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), count()
        for batch in batches:
            ids = pa.array([(part << 36) + next(made) for _ in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *batch.columns], names=["row", "key", "n_bytes", "text"])

    return stored(arrow_map(rows.select("key", "n_bytes", "text"), run, f"row bigint, key {kind}, n_bytes bigint, text string"), "token-long")


def _chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                cuts = cut_points(text, chunk, overlap)
                for n, (a, b) in enumerate(cuts):
                    # the next chunk's start: both sides look for boundaries from there on
                    seam = cuts[n + 1][0] if n + 1 < len(cuts) else b
                    yield pa.RecordBatch.from_pydict({"row": [row], "chunk": [n], "start": [a], "seam": [seam], "part": [text[a:b]],
                                                      "head": [min(cuts[n - 1][1], b) if n else a]},
                                                     schema=pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()),
                                                                       ("seam", pa.int64()), ("part", pa.binary()), ("head", pa.int64())]))

    return arrow_map(rows.select("row", "text"), run, "row bigint, chunk bigint, start bigint, seam bigint, part binary, head bigint")


def _encode_chunks(chunks: DataFrame, vocabulary: str) -> DataFrame:
    """Per chunk: its tokens and the (position, token id, tokens before / from here on)
    of the stable boundaries it shares with the chunk before and after."""
    side = "array<struct<pos:bigint,id:bigint,n:bigint>>"
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("id", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(vocabulary)
        for batch in batches:
            out: dict[str, list] = {"row": [], "chunk": [], "n": [], "head": [], "tail": []}
            for r in batch.to_pylist():
                ids = tok.ids(r["part"].decode())
                starts = np.concatenate(([0], np.cumsum(tok.lengths[ids])))[:-1]

                def found(low: int, high: int, after: bool, r=r, ids=ids, starts=starts) -> list[dict]:
                    at = stable_starts(r["part"], starts, low - r["start"], high - r["start"])
                    return [{"pos": int(starts[k]) + r["start"], "id": int(ids[k]), "n": len(ids) - int(k) if after else int(k)} for k in at]

                end = r["start"] + len(r["part"])
                for k, v in zip(out, (r["row"], r["chunk"], len(ids), found(r["start"], r["head"], False), found(r["seam"], end, True)), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("row", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("head", kind), ("tail", kind)]))

    return arrow_map(chunks, run, f"row bigint, chunk bigint, n bigint, head {side}, tail {side}")


def _splice(encoded: DataFrame) -> DataFrame:
    """(row, n_tokens, whole): tokens of all chunks less what each seam counts
    twice; ``whole`` is false where a seam found no common boundary."""
    left = encoded.select("row", "chunk", F.explode("tail").alias("x")).select("row", "chunk", "x.pos", "x.id", F.col("x.n").alias("after"))
    right = encoded.select("row", (F.col("chunk") - 1).alias("chunk"), F.explode("head").alias("x")).select("row", "chunk", "x.pos", "x.id", F.col("x.n").alias("before"))
    seams = (left.join(right, ["row", "chunk", "pos", "id"]).groupBy("row", "chunk")
             .agg(F.min_by(F.col("after") + F.col("before"), "pos").alias("twice"))
             .groupBy("row").agg(F.sum("twice").alias("twice"), F.count("*").alias("seams")))
    sums = encoded.groupBy("row").agg(F.sum("n").alias("n"), F.count("*").alias("chunks"))
    return sums.join(seams, "row", "left").select(
        "row", (F.col("n") - F.coalesce("twice", F.lit(0))).alias("n_tokens"),
        (F.coalesce("seams", F.lit(0)) == F.col("chunks") - 1).alias("whole"))


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY,
                 chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """(key, n_bytes, n_tokens) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    content = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("n_bytes"), content.alias("text"))
    if load_tokenizer(vocabulary).lengths is None:
        return _count_short(rows, vocabulary, kind)
    short = _count_short(rows.where(F.col("n_bytes") <= chunk_bytes), vocabulary, kind)
    todo = _number_rows(rows.where(F.col("n_bytes") > chunk_bytes), kind)
    longest = todo.agg(F.max("n_bytes")).first()[0] or 0
    while longest:
        overlap_bytes = min(overlap_bytes, chunk_bytes)
        spliced = stored(_splice(stored(_encode_chunks(_chunks(todo, chunk_bytes, overlap_bytes).repartition("row", "chunk"), vocabulary), "token-chunks")), "token-spliced")
        done = todo.drop("text").join(spliced.where("whole"), "row").select("key", "n_bytes", "n_tokens")
        short = short.unionByName(done)
        if spliced.where("not whole").isEmpty():
            break
        todo = todo.join(spliced.where("not whole").select("row"), "row", "left_semi")
        overlap_bytes *= WIDEN
        chunk_bytes = max(chunk_bytes, 4 * overlap_bytes)
    return short


def count_table(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    return token_counts(docs).select(F.col("key").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
