"""Secret scanning with patterns and character Markov models (DataFrame functions only).

Three patterns give the base spans.  Further spans come from two first-order
character Markov models, one of random strings and one of ordinary identifiers:
a run of ``MIN_RUN`` or more key characters that overlaps no base span is a
secret if its log-likelihood ratio (random over ordinary) exceeds ``MARGIN``, and
``MARGIN_EACH`` for each character.

Training samples are labelled by the patterns: their values are random strings,
the other words of the same documents are ordinary identifiers (but those long
enough to be judged themselves, which stay unlabelled).  They come from
about ``SAMPLE_DOCS`` documents, chosen by the hash of id and text (all, where
there are fewer); the models have at most 2 × 68 × 67 numbers, which is all that
reaches the driver.  Scanning then covers every whole text, row by row, without
a shuffle.

Positions count code points, ends are exclusive.  They come from splitting the
text at the matches: the pieces and matches alternate, and their lengths are
summed in blocks, so a text with very many matches stays near-linear.

Defined results: a null text is empty and has no spans; repeated rows and null ids
keep a row each; without any sample both models are uniform and add no span; an
empty table gives an empty result."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import free_name, words

#: Base kinds in rank order: pattern, group that is measured, its least length.
PATTERNS: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: A cheap necessary condition for each kind; texts without it skip the extraction.
NEEDED = {"assign": PATTERNS[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MARKOV = "markov"
MIN_RUN = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
SAMPLE_DOCS = 4000
#: Weight of a character's chance anywhere in its chance after another, in observations.
WEIGHT = 10.0
#: Share of the uniform distribution in the chance anywhere.
FLOOR = 0.01
#: Natural logarithm of the odds that a run must reach, in all and for each character.
MARGIN = 12.0
MARGIN_EACH = 1.0

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def of_blocks(blocks: Column) -> Column:
        return let(F.transform(blocks, lambda b: total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))),
                   lambda each: F.transform(blocks, lambda b: total(F.slice(each, F.lit(1), b))))

    def starts(before: Column) -> Column:
        return F.transform(lengths, lambda _, i: F.get(before, F.floor(i / _BLOCK).cast("int")) + total(
            F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)))

    numbers = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))
    return F.when(F.size(lengths) > 0, let(of_blocks(numbers), starts)).otherwise(F.array().cast("array<int>"))


def spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int, needed: str) -> Column:
    """Array of the pattern's matches whose group has ``least`` or more characters."""
    def made(s: Column) -> Column:
        parts, hits = s["parts"], s["hits"]
        pair = F.transform(hits, lambda h, i: F.length(F.get(parts, i)) + F.length(h))
        return let(pair, lambda both: let(sums_before(both), lambda before: F.transform(hits, lambda h, i: F.struct(
            (F.get(before, i) + F.length(F.get(parts, i))).cast("int").alias("start"), F.lit(rank).alias("rank"),
            (F.get(before, i) + F.get(both, i)).cast("int").alias("end"), F.lit(kind).alias("kind")))))

    def checked(s: Column) -> Column:
        if not group:
            return F.filter(made(s), lambda x: x["end"] - x["start"] >= least)
        return F.filter(made(s), lambda x, i: F.length(F.get(s["values"], i)) >= least)

    fields = [F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")]
    if group:
        fields.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"))
    return F.when(text.rlike(needed), let(F.struct(*fields), checked)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    return F.concat(*[spans(text, k, n, p, g, least, NEEDED[k]).cast(SPAN) for n, (k, p, g, least) in enumerate(PATTERNS)])


def _steps(token: Column) -> Column:
    """The characters' numbers: (previous or the start state, this)."""
    def number(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    return F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.struct(
        F.when(i == 1, F.lit(len(ALPHABET))).otherwise(number(i - 1)).alias("a"), number(i).alias("b")))


def _at_least(values: Column, least: int) -> Column:
    return F.filter(values, lambda x: F.length(x) >= least)


def _number_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratios by (previous, this) character, row after row; the last
    row is the start state."""
    n = docs.count()
    share = min(1.0, sample_docs / n) if n else 1.0
    place = F.pmod(F.xxhash64(f"`{key}`", f"`{text}`"), F.lit(1 << 40))
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    chosen = docs.where(place < int(share * (1 << 40)) + 1).select(t.alias("t"))
    values = [F.regexp_extract_all("t", F.lit(p), F.lit(g)) for _, p, g, _ in PATTERNS]
    found = [_at_least(v, least) for v, (_, _, _, least) in zip(values, PATTERNS, strict=True)]
    bare = F.col("t")
    for _, p, _, _ in PATTERNS[:2]:
        bare = F.regexp_replace(bare, p, " ")
    bare = F.regexp_replace(bare, r"[0-9a-f]{24,}", " ")
    plain = F.filter(words(F.regexp_replace(bare, r"[^A-Za-z0-9+/_=-]", " ")), lambda w: w.rlike("^[A-Za-z_]") & F.length(w).between(4, MIN_RUN - 1))
    labelled = chosen.select(F.lit(1).alias("random"), F.explode(F.concat(*found)).alias("s")).unionByName(
        chosen.select(F.lit(0).alias("random"), F.explode(F.array_distinct(plain)).alias("s"))).distinct()
    steps = labelled.select("random", F.explode(_steps(F.col("s"))).alias("x")).where("x.a >= 0 and x.b >= 0")
    counts = {(r.random, r.a, r.b): r.n for r in steps.groupBy("random", "x.a", "x.b").agg(F.count("*").alias("n")).collect()}
    return log_ratios(counts)


def log_ratios(counts: dict[tuple[int, int, int], int]) -> list[float]:
    """The ratios from counts by (model, previous, this).  A character's chance after
    another is drawn towards its chance anywhere, and that towards a uniform one,
    by the same shares in both models, so what neither has seen decides nothing."""
    size = len(ALPHABET)

    def chances(model: int) -> list[list[float]]:
        own = [[counts.get((model, a, b), 0) for b in range(size)] for a in range(size + 1)]
        total = sum(map(sum, own))
        anywhere = [(1 - FLOOR) * sum(row[b] for row in own) / total + FLOOR / size if total else 1 / size for b in range(size)]
        return [[(n + WEIGHT * p) / (sum(row) + WEIGHT) for n, p in zip(row, anywhere, strict=True)] for row in own]

    ordinary, random = chances(0), chances(1)
    return [round(math.log(r) - math.log(o), 6) for x, y in zip(random, ordinary, strict=True) for r, o in zip(x, y, strict=True)]


def score(token: Column, ratios: Column) -> Column:
    """Log-likelihood ratio of a string of key characters."""
    return F.aggregate(_steps(token), F.lit(0.0), lambda total, x: total + F.get(ratios, x["a"] * len(ALPHABET) + x["b"]))


def markov_spans(text: Column, base: Column, model: list[float], margin: float = MARGIN, each: float = MARGIN_EACH) -> Column:
    """Runs that overlap no base span and score above the margins."""
    ratios = F.from_json(F.lit(json.dumps(model)), "array<double>")
    runs = spans(text, MARKOV, len(PATTERNS), RUN, 0, MIN_RUN, RUN)
    return F.filter(runs, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])) & (
        score(F.substring(text, x["start"] + 1, x["end"] - x["start"]), ratios) > F.greatest(F.lit(margin), each * (x["end"] - x["start"]))))


def with_spans(docs: DataFrame, out: str, text: str = "text", key: str = "doc_id", model: list[float] | None = None) -> DataFrame:
    """``docs`` with one more column: a struct of ``base`` and ``all`` spans, sorted
    by start, then kind."""
    model = train(docs, text, key) if model is None else model
    t, base = free_name(docs, "__text"), free_name(docs, "__base")
    keep = [F.col(f"`{c}`") for c in docs.columns]
    step = docs.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(t))
    step = step.select(*keep, t, F.sort_array(base_spans(F.col(t))).alias(base))
    both = F.sort_array(F.concat(F.col(base), markov_spans(F.col(t), F.col(base), model)))
    return step.select(*keep, F.struct(F.col(base).alias("base"), both.alias("all")).alias(out))


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_table(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the base digest and all spans."""
    got = with_spans(docs.select("doc_id", "text"), "s")
    base = F.col("s.base")
    return got.select("doc_id", *[_number_of(base, k).alias(f"n_{k}") for k, *_ in PATTERNS],
                      F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s.all")).alias("spans"))
