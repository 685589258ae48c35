"""Benchmark decontamination through a distributed positional inverted index.

The corpus is cut into segments of about ``SEGMENT_WORDS`` words (whole
documents).  A segment is one row of a table in the shared folder: its distinct
terms (64-bit hashes, sorted) and, for each, the sorted positions of all its
occurrences.  Segments are built where the documents are read, so neither
building nor searching shuffles any postings.

A phrase is searched in a segment from its rarest term there: the positions of
that term, moved back by its place in the phrase, are the candidate starts, and
each further term, next rarest first, keeps those of them that its own moved
list contains.  A phrase with a term that the segment lacks ends at once.

Proximity finds passages with words put in or moved: a window matches a document
that has its words, each as often as the window has it and in any order, within
``SLACK`` words more than the window is long.  Exact matches are among them; an item
of one word is near wherever it stands.  Both searches take one pass over the index.
The contamination rule reads exact matches only.

The benchmark is brought to the tasks in blocks of at most ``BLOCK_BYTES`` of
text, one pass over the index for each block, so a large benchmark costs more
passes and never more memory.

Defined results: null and empty texts have no words and no hits; an item without
words has no windows; a null item id is written as an empty string; repeated
items count once by id; repeated documents keep a row each; an empty benchmark
gives zero hits; an empty corpus an empty result."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import arrow_map, stored

WINDOW = 13
#: Words that proximity allows between those of a window.
SLACK = 4
SEGMENT_WORDS = 400_000
#: Text of benchmark items held by a task at a time.
BLOCK_BYTES = 16 << 20

#: A-Z become a-z; ASCII characters other than letters and digits become spaces.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

SEGMENT = ("segment bigint, terms binary, starts binary, positions binary, doc_starts binary, "
           "docs array<struct<key:{key},n_words:bigint>>")


def item_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters and digits and non-ASCII characters, A-Z lowered."""
    return (text or b"").translate(_FOLD).split()


def _term(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index table, written to the shared folder.  A segment holds whole
    documents, so one very long document makes one larger segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), count()
        state: dict = {}

        def start() -> None:
            state.update(ids=defaultdict(count().__next__), words=[], keys=[], ends=[0])

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(state["words"]) if state["words"] else np.zeros(0, np.int64)
            terms = np.array([_term(w) for w in state["ids"]], dtype=np.uint64)
            order = np.argsort(terms)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            by_term = np.sort((rank[ids] << 32) | np.arange(len(ids)))
            starts = np.searchsorted(by_term, np.arange(len(order) + 1) << 32).astype(np.int32)
            arrays = [pa.array([(part << 33) + next(made)], pa.int64())] + [
                pa.array([a.tobytes()], pa.binary()) for a in (terms[order], starts, (by_term & 0xFFFFFFFF).astype(np.int32),
                                                             np.array(state["ends"], dtype=np.int64))]
            rows = pa.StructArray.from_arrays([pa.concat_arrays(state["keys"]), pa.array(np.diff(state["ends"]), pa.int64())], names=["key", "n_words"])
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows))
            return pa.RecordBatch.from_arrays(arrays, names=["segment", "terms", "starts", "positions", "doc_starts", "docs"])

        start()
        for batch in batches:
            begun = 0
            for i, text_bytes in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                w = item_words(text_bytes)
                state["words"].append(np.fromiter(map(state["ids"].__getitem__, w), np.int64, len(w)))
                state["ends"].append(state["ends"][-1] + len(w))
                if state["ends"][-1] >= segment_words:
                    state["keys"].append(batch.column(0).slice(begun, i + 1 - begun))
                    begun = i + 1
                    yield flush()
                    start()
            state["keys"].append(batch.column(0).slice(begun))
        if len(state["ends"]) > 1:
            yield flush()

    kind = docs.schema[key].dataType.simpleString()
    made = arrow_map(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")), run, SEGMENT.format(key=kind))
    return stored(made, "decontam-index")


class Segment:
    """One segment's postings, opened for search."""

    def __init__(self, terms: bytes, starts: bytes, positions: bytes, doc_starts: bytes) -> None:
        self.terms = np.frombuffer(terms, np.uint64)
        self.starts = np.frombuffer(starts, np.int32)
        self.positions = np.frombuffer(positions, np.int32)
        self.doc_starts = np.frombuffer(doc_starts, np.int64)

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term stands in the directory, and its number of postings (0: absent)."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        n = (self.starts[at + 1] - self.starts[at]).astype(np.int64)
        return at, np.where(self.terms[at] == terms, n, 0)

    def postings(self, place: int) -> np.ndarray:
        return self.positions[self.starts[place]:self.starts[place + 1]]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, positions, side="right") - 1

    def phrase(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Start positions at which the terms follow each other inside one document."""
        order = np.argsort(counts, kind="stable")
        found = self.postings(places[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                return found
            own = self.postings(places[k])
            want = found + k
            at = np.minimum(np.searchsorted(own, want), len(own) - 1)
            found = found[own[at] == want]
        found = found[found >= 0]
        return found[self.doc_of(found) == self.doc_of(found + len(places) - 1)]

    def near(self, places: np.ndarray, counts: np.ndarray, slack: int) -> np.ndarray:
        """Documents with a stretch of ``slack`` words more than the terms that contains
        each term as often as it is given."""
        terms, times = np.unique(places, return_counts=True)
        own = {p: self.postings(p) for p in terms.tolist()}
        often = dict(zip(terms.tolist(), times.tolist(), strict=True))
        order = sorted(own, key=lambda p: (len(own[p]), p))
        length = len(places) + slack
        found = own[order[0]].astype(np.int64)
        for p in order[1:]:
            doc = self.doc_of(found)
            low = np.maximum(found - length + 1, self.doc_starts[doc])
            high = np.minimum(found + length, self.doc_starts[doc + 1])
            found = found[np.searchsorted(own[p], low) < np.searchsorted(own[p], high)]
            if not len(found):
                return found
        doc = np.repeat(self.doc_of(found), length)
        starts = (found[:, None] - np.arange(length)[None, :]).ravel()
        ok = starts >= self.doc_starts[doc]
        starts, doc = starts[ok], doc[ok]
        for p in order:
            at = np.searchsorted(own[p], starts) + often[p] - 1
            last = own[p][np.minimum(at, len(own[p]) - 1)]
            ok = (at < len(own[p])) & (last < np.minimum(starts + length, self.doc_starts[doc + 1]))
            starts, doc = starts[ok], doc[ok]
        return np.unique(doc)


class Queries:
    """A block of items: their windows as rows of term numbers, by window length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int, slack: int | None = None) -> None:
        number: dict[int, int] = {}
        by_size: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            w = [number.setdefault(_term(x), len(number)) for x in item_words(text)]
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                by_size[size][tuple(w[i:i + size])].add(item)
        self.slack = slack
        self.terms = np.array(list(number), dtype=np.uint64)
        self.windows = [(size, np.array(list(rows), dtype=np.int64), list(rows.values())) for size, rows in by_size.items()]

    def search(self, seg: Segment) -> Iterator[tuple[np.ndarray, int, np.ndarray, set[str]]]:
        """(positions, words covered from each, documents found by proximity, items) of
        each window that occurs in either way."""
        at, n = seg.places(self.terms)
        none = np.zeros(0, np.int64)
        for size, rows, items in self.windows:
            for r in np.nonzero(n[rows].min(axis=1) > 0)[0]:
                places, counts = at[rows[r]], n[rows[r]]
                found = seg.phrase(places, counts)
                near = none if self.slack is None else seg.near(places, counts, self.slack)
                if len(found) or len(near):
                    yield found, size, near, items[r]


def _matches(index: DataFrame, queries: Queries) -> DataFrame:
    """(segment, ord, words, items, near): numbers of the words hit in a document, the
    items that hit them, and those found by proximity."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ident, *parts = (batch.column(c)[row].as_py() for c in range(5))
                seg = Segment(*parts)
                hit = np.zeros(int(seg.doc_starts[-1]), bool)
                items: dict[int, set[str]] = defaultdict(set)
                close: dict[int, set[str]] = defaultdict(set)
                for found, covers, near, names in shared.value.search(seg):
                    for k in range(covers):
                        hit[found + k] = True
                    for d in np.unique(seg.doc_of(found)).tolist():
                        items[d] |= names
                    for d in near.tolist():
                        close[d] |= names
                out: dict[str, list] = {"segment": [], "ord": [], "words": [], "items": [], "near": []}
                for d in sorted(items.keys() | close.keys()):
                    a, b = seg.doc_starts[d:d + 2]
                    for k, v in zip(out, (ident, d, np.nonzero(hit[a:b])[0].astype(np.int32), sorted(items[d]), sorted(close[d])), strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("segment", pa.int64()), ("ord", pa.int32()), ("words", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))]))

    return arrow_map(index.select("segment", "terms", "starts", "positions", "doc_starts"), run,
                     "segment bigint, ord int, words array<int>, items array<string>, near array<string>")


def search_index(index: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW,
                 slack: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(segment, ord, words, items, near) for each document that holds a window of an
    item: the exact phrase, and with ``slack`` its words in any order close together."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    found = None
    for b in range(blocks):
        items = [(r.item, bytes(r.text) if r.text is not None else None)
                 for r in rows.where(block == b).select("item", F.col("text").cast("binary").alias("text")).toLocalIterator()]
        one = _matches(index, Queries(items, window, slack))
        found = one if found is None else found.unionByName(one)
    if blocks == 1:
        return found
    return found.groupBy("segment", "ord").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("words", "items", "near")])


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
                  item_text: str = "text", item: str = "item_id", window: int = WINDOW, slack: int | None = None) -> DataFrame:
    """(key, n_words, n_hit, items): one row per document.  With ``slack`` also
    ``near_items``, the items of which a window is found by proximity."""
    index = build_index(docs, text, key)
    found = stored(search_index(index, benchmark, item_text, item, window, slack), "decontam-matches")
    listed = index.select("segment", F.posexplode("docs").alias("ord", "d")).select("segment", "ord", "d.key", "d.n_words")
    none = F.array().cast("array<string>")
    out = ["key", "n_words", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.array_sort("items"), none).alias("items")]
    if slack is not None:
        out.append(F.coalesce(F.array_sort("near"), none).alias("near_items"))
    return listed.join(found, ["segment", "ord"], "left").select(*out)


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """Benchmark windows cover at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, columns unchanged.  The verdict depends
    on the text alone, so texts are matched by their SHA-256."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    own = F.sha2(F.col(f"`{text}`").cast("string"), 256)
    keyed = docs.select(own.alias("k"), F.col(f"`{text}`").alias("t"))
    bad = contamination(keyed, benchmark, "t", "k").where(contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col("key").alias("__k")).distinct()
    return docs.join(bad, own == F.col("__k"), "left_anti").select(*cols)


def contamination_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with the digest of its items, and the number of items
    found in it by proximity."""
    got = contamination(docs, benchmark, slack=SLACK)
    return got.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"))
