"""Language-model scores from a weighted backoff automaton over words.

The model is a smoothed bigram model.  Its automaton has a state for each known
word and for the start, and the empty state.  A state's arcs carry
log10((c(v w) + MU p(w)) / (c(v) + MU)); where there is no arc, the failure arc
of weight log10(MU / (c(v) + MU)) leads to the empty state, whose arcs carry
log10 p(w), p(w) = (c(w) + 1) / (N + V + 1).  Both ways give one distribution
that sums to 1.  A text is scored in one pass from left to right: each step takes
an arc, or the failure arc and an arc of the empty state, and the word taken is
the next state (the empty state after an unknown word).

The corpus's n-grams are never brought together in one place.  Documents are
read into blocks of about ``BLOCK_WORDS`` words.  A block sends the hashes and
training counts of its distinct n-grams to buckets (ranges of the hash; their
number follows the size of the input).  A bucket adds the counts up over all
blocks and answers each block with the totals of the n-grams it asked for, in
the order it asked.  With these the block has exactly the part of the automaton
that its own documents can reach.  A frequent n-gram is sent once per block, so
it makes no hot key.  All n-grams are used; nothing is pruned.  N-grams are
told apart by 64-bit hashes.

Defined results: a null text is empty and consists of the end token; repeated rows
keep a row each, and count as often in training; the remainder of a null id is
that of the empty string; without training documents N = V = 0 and every token is
unknown; an empty table gives an empty result."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import arrow_map, byte_words, stored

BLOCK_WORDS = 1_000_000
#: Longer documents are walked in segments of this many tokens, side by side.
SEGMENT = 512
#: Text bytes per bucket of n-grams.
BUCKET_BYTES = 16 << 20
#: Weight of the word distribution in a state, as a number of observations.
MU = 300.0
FOLDS, HELD_OUT = 7, 2

#: Neither can be a word: words hold no line feed.
START, END = b"\n\n", b"\n"
_ZSTD = "zstd"


def is_held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def squeeze(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, byte plane by byte plane."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros(0, np.uint8)
    raw = planes.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_ZSTD, asbytes=True)


def unsqueeze(blob: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec=_ZSTD, asbytes=True), np.uint8)
    item = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(item, -1).T).view(kind).reshape(-1)


def squeeze_sorted(a: np.ndarray) -> bytes:
    """The same for increasing uint64 numbers, as differences."""
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def unsqueeze_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob, "<u8"), dtype=np.uint64)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two words' hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


class Block:
    """Documents as local word numbers (0 is the start, 1 the end), one after another."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray, held: np.ndarray) -> None:
        self.hashes, self.ids, self.starts, self.held = hashes, ids, starts, held
        n = np.diff(starts)
        self.trained = np.repeat(~held, n)
        self.before = np.empty_like(ids)
        self.before[1:] = ids[:-1]
        self.before[starts[:-1]] = 0
        code = (self.before.astype(np.int64) << 32) | ids
        pairs, self.pair = np.unique(code, return_inverse=True)
        keys = pair_hash(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF])
        # equal keys of different pairs would be one n-gram; at 64 bits that is not expected
        self.keys, rank = np.unique(keys, return_inverse=True)
        self.pair = rank[self.pair]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes of the words, their local numbers); the start is none."""
        order = np.argsort(self.hashes[1:]) + 1
        return self.hashes[order], order

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.ids[self.trained], minlength=len(self.hashes))

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair[self.trained], minlength=len(self.keys))


def read_blocks(docs: DataFrame, text: str = "text", key: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of tokenised documents, one row each, in a stored table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), count()
        state: dict = {}

        def start() -> None:
            ids = defaultdict(count().__next__)
            ids[START], ids[END] = 0, 1
            for _ in range(2):
                ids.default_factory()
            state.update(ids=ids, words=[], starts=[0], held=[], keys=[])

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in state["ids"]), np.uint64, len(state["ids"]))
            keys = pa.concat_arrays(state["keys"])
            blobs = [hashes.tobytes(), squeeze(np.concatenate(state["words"])), np.array(state["starts"], np.int64).tobytes(),
                     np.array(state["held"], bool).tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 33) + next(made)], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs),
                 pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)],
                names=["block", "hashes", "ids", "starts", "held", "keys"])

        start()
        for batch in batches:
            begun = 0
            names = batch.column(0).to_pylist()
            for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                w = byte_words(t or b"")
                w.append(END)
                state["words"].append(np.fromiter(map(state["ids"].__getitem__, w), np.int32, len(w)))
                state["starts"].append(state["starts"][-1] + len(w))
                state["held"].append(is_held_out(names[i]))
                if state["starts"][-1] >= block_words:
                    state["keys"].append(batch.column(0).slice(begun, i + 1 - begun))
                    begun = i + 1
                    yield flush()
                    start()
            state["keys"].append(batch.column(0).slice(begun))
        if len(state["starts"]) > 1:
            yield flush()

    kind = docs.schema[key].dataType.simpleString()
    made = arrow_map(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")), run,
                     f"block bigint, hashes binary, ids binary, starts binary, held binary, keys array<{kind}>")
    return stored(made, "lm-blocks")


def _open(hashes: bytes, ids: bytes, starts: bytes, held: bytes) -> Block:
    return Block(np.frombuffer(hashes, np.uint64), unsqueeze(ids, "<i4"), np.frombuffer(starts, np.int64), np.frombuffer(held, bool))


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of the sorted hashes begins."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _ask(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each block's n-grams and training counts, cut into buckets."""
    names = ["block", "bucket", "words", "word_n", "pairs", "pair_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ident, *parts = (batch.column(c)[row].as_py() for c in range(5))
                block = _open(*parts)
                words, order = block.words()
                sides = [(words, block.word_counts()[order], _bounds(words, buckets)), (block.keys, block.pair_counts(), _bounds(block.keys, buckets))]
                out: list[list] = [[] for _ in names]
                # only buckets that the block has n-grams for: never more rows than n-grams
                for b in np.nonzero(sum(np.diff(at) for _, _, at in sides))[0].tolist():
                    blobs = []
                    for keys, n, at in sides:
                        cut = slice(at[b], at[b + 1])
                        blobs += [squeeze_sorted(keys[cut]), squeeze(n[cut].astype("<u4"))]
                    for o, v in zip(out, [ident, b, *blobs], strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(o, pa.binary()) for o in out[2:])], names=names)

    return arrow_map(blocks.select("block", "hashes", "ids", "starts", "held"), run,
                     "block bigint, bucket int, words binary, word_n binary, pairs binary, pair_n binary")


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's totals, for each block in the order of its request."""
    out = pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"]})
    for name in ("word", "pair"):
        keys = [unsqueeze_sorted(b) for b in rows[f"{name}s"]]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([unsqueeze(b, "<u4") for b in rows[f"{name}_n"]])).astype("<u8")
        ends = np.cumsum([len(k) for k in keys])
        out[f"{name}_n"] = [squeeze(total[p]) for p in np.split(place, ends[:-1])]
        if name == "word":
            # the bucket's share of N and V, once
            out["tokens"] = [int(total.sum())] + [0] * (len(rows) - 1)
            out["types"] = [int((total > 0).sum())] + [0] * (len(rows) - 1)
    return out


class Automaton:
    """The states and arcs that one block's documents can reach.  A state is the number of
    the word it stands for (0: the start); ``empty`` is the last one.  Arcs of the empty
    state are arrays over words; those of the others are sorted by (state, word)."""

    def __init__(self, block: Block, word_n: np.ndarray, pair_n: np.ndarray, tokens: int, types: int, mu: float = MU) -> None:
        self.block = block
        _, order = block.words()
        self.n = np.zeros(len(block.hashes), np.int64)
        self.n[order] = word_n
        p = (self.n + 1) / (tokens + types + 1)
        self.empty = len(block.hashes)
        self.empty_arc = np.log10(p)
        # every training document has one start and one end
        seen = self.n.copy()
        seen[0] = self.n[1]
        # a word that training lacks leads to the empty state, which has no failure arc
        self.state_of = np.where(seen > 0, np.arange(self.empty), self.empty)
        self.failure_arc = np.append(np.log10(mu / (seen + mu)), 0.0)
        first = np.empty(len(block.keys), np.int64)
        first[block.pair] = np.arange(len(block.pair))
        first = first[pair_n > 0]
        v, w = block.before[first].astype(np.int64), block.ids[first].astype(np.int64)
        weight = np.log10((pair_n[pair_n > 0] + mu * p[w]) / (seen[v] + mu))
        place = np.argsort((v << 32) | w)
        self.arcs, self.arc = ((v << 32) | w)[place], weight[place]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log10 weights): the state's own arc, or its failure arc and then
        the empty state's arc."""
        weight = self.failure_arc[state] + self.empty_arc[word]
        if len(self.arcs):
            code = (state << 32) | word
            at = np.minimum(np.searchsorted(self.arcs, code), len(self.arcs) - 1)
            weight = np.where(self.arcs[at] == code, self.arc[at], weight)
        return self.state_of[word], weight

    def walk(self, segment: int = SEGMENT) -> np.ndarray:
        """log10 probability of every document, in one pass from left to right that carries
        each one's state.  Documents advance side by side; a long one is cut into segments,
        whose first state is reached from the empty state by the word before: any way into
        a word ends in the same state."""
        starts, ids = self.block.starts, self.block.ids.astype(np.int64)
        sizes = np.diff(starts)
        parts = -(-sizes // segment)
        doc = np.repeat(np.arange(len(sizes)), parts)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = starts[doc] + within * segment
        left = np.minimum(segment, starts[doc + 1] - begin)
        longest = np.argsort(-left, kind="stable")
        doc, within, begin, left = doc[longest], within[longest], begin[longest], left[longest]
        warm, _ = self.step(np.full(len(doc), self.empty), ids[np.maximum(begin - 1, 0)])
        state = np.where(within > 0, warm, self.state_of[0])
        total = np.zeros(len(doc))
        going = np.searchsorted(-left, -np.arange(left[0]), side="left")
        for t, n in enumerate(going.tolist()):
            state, weight = self.step(state[:n], ids[begin[:n] + t])
            total[:n] += weight
        return np.bincount(doc, weights=total, minlength=len(sizes))


def lm_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", mu: float = MU, block_words: int = BLOCK_WORDS,
              bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")).cast("long"))).first()[0] or 0
    buckets = int(size // bucket_bytes) + 1
    blocks = read_blocks(docs, text, key, block_words)
    replies = stored(_ask(blocks, buckets).groupBy("bucket").applyInPandas(
        _answer, "block bigint, bucket int, word_n binary, pair_n binary, tokens bigint, types bigint"), "lm-counts")
    sums = replies.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = sums[0] or 0, sums[1] or 0
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _open(*(batch.column(c)[row].as_py() for c in range(1, 5)))
                reply = batch.column(6)[row].as_py()
                totals = [np.concatenate([unsqueeze(r[n], "<u8") for r in sorted(reply, key=lambda r: r["bucket"])]).astype(np.int64) for n in ("word_n", "pair_n")]
                auto = Automaton(block, *totals, tokens, types, mu)
                cut = block.starts[:-1]
                keys = batch.column(5).slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(block.held), pa.array(np.diff(block.starts), pa.int64()),
                     pa.array(np.add.reduceat((auto.n[block.ids] > 0).astype(np.int64), cut), pa.int64()),
                     pa.array(np.full(len(cut), tokens, np.int64)), pa.array(np.add.reduceat(auto.empty_arc[block.ids], cut)),
                     pa.array(auto.walk())],
                    names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    by_block = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "word_n", "pair_n")).alias("replies"))
    return arrow_map(blocks.join(by_block, "block").select("block", "hashes", "ids", "starts", "held", "keys", "replies"), run,
                     f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
