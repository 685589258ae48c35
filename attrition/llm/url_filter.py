"""URL filter: rules, and for what they leave open two character models (DataFrame functions only).

A rule (verdict, host, path) fits a URL on its host or a subdomain of it whose path
starts with the rule's; of those that fit the longest one (host and path) decides, of
equally long ones the first.  The host is what stands between the first ``://`` and the
next ``/``, ``?``, ``#`` or the end, A-Z lowered; the path follows it up to ``?``, ``#``
or the end.

URLs that the rules decide are the labelled rows: two variable-order Markov models are
trained, one of accepted and one of blocked URLs.  A character's chance depends on the
longest kept context before it, of at most ``ORDER`` characters; a context is kept if it
stands before at least one of ``SHARE`` characters of the URLs counted, so there are
at most 1 + ORDER * SHARE contexts.  Each chance is drawn towards the one after the next
shorter context by ``WEIGHT`` observations, at the end towards a uniform one.

The score of a URL is the log-likelihood difference (accepted less blocked) by
character, the end being one.  Scores are calibrated on a quarter of the labelled URLs,
which the counts leave out: a logistic curve is fitted to them, both classes weighing
the same, and a URL is blocked if blocked is the likelier class.  Every distinct labelled
URL takes part, three quarters in the counts and the others in the calibration, and
every one whole; long ones are counted in pieces of ``PIECE`` characters.

Contexts are the states of an automaton with failure links folded into its moves, one
constant array for each of its two tables, walked from left to right by one aggregate
over the URL's characters: no shuffle, no join.

Defined results: a null URL, and one without ``://``, has an empty host and path; a null
one is scored as empty text; if the rules accept or block nothing in the table, every
other URL is allowed; repeated rows keep a row each; an empty table gives an empty result."""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import free_name

ALLOW, BLOCK = "allow", "block"
#: Fixed values: (verdict, host, path).
RULES: tuple[tuple[str, str, str], ...] = (
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
)

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~/?#=&%:+@"
#: Number 0 is any other character, the last one the end.
SYMBOLS = len(ALPHABET) + 2
END = SYMBOLS - 1
ORDER = 5
SHARE = 400
WEIGHT = 4.0
#: Characters of a URL that a row holds while they are counted.
PIECE = 1_000
#: Newton steps of the calibration, and what keeps it finite where the classes part.
STEPS, RIDGE = 25, 1e-3


class Model(NamedTuple):
    """``moves`` and ``gains`` by state and symbol; a URL is blocked if slope * score + offset < 0."""

    moves: list[int]
    gains: list[float]
    slope: float
    offset: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both as columns, empty for a URL without them."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The deciding rule's number, or null."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    out = F.lit(None).cast("int")
    for i in reversed(order):
        _, h, p = rules[i]
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def _letters(url: Column) -> Column:
    """The characters' numbers."""
    letters = F.filter(F.split(F.coalesce(url.cast("string"), F.lit("")), ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c))


def _symbols(url: Column) -> Column:
    """The characters' numbers, and the end."""
    return F.concat(_letters(url), F.array(F.lit(END)))


def _sample(pages: DataFrame, url: str, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """(verdict, url, held): labelled URLs, each once, a quarter of them held for calibration."""
    u = F.col(f"`{url}`")
    rows = pages.select(u.cast("string").alias("url"), fitting_rule(*host_and_path(u), rules).alias("rule"))
    verdict = F.element_at(F.array(*[F.lit(v) for v, _, _ in rules]), F.col("rule") + 1)
    rows = rows.where("rule IS NOT NULL").select(verdict.alias("verdict"), "url").distinct()
    return rows.select("verdict", "url", (F.pmod(F.xxhash64("url", F.lit("held")), F.lit(4)) == 0).alias("held"))


def _counts(sample: DataFrame) -> dict[tuple[int, ...], dict[tuple[str, int], int]]:
    """Context → (verdict, next symbol) → count, of the contexts that are kept."""
    last = F.floor(F.length("url") / PIECE).cast("int")
    pieces = sample.select("verdict", "url", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    lead = F.when(F.col("piece") > 0, ORDER).otherwise(0)
    text = F.substring(F.col("url"), F.col("piece") * PIECE + 1 - lead, lead + PIECE)
    symbols = F.when(F.col("piece") == F.col("last"), _symbols(text)).otherwise(_letters(text))
    places = pieces.select("verdict", symbols.alias("s"), (lead + 1).alias("at")).where(F.col("at") <= F.size("s")).select(
        "verdict", "s", F.explode(F.sequence(F.col("at"), F.size("s"))).alias("i"))
    contexts = F.transform(F.sequence(F.lit(0), F.least(F.lit(ORDER), F.col("i") - 1)), lambda k: F.slice("s", F.col("i") - k, k))
    own = places.select("verdict", F.element_at("s", F.col("i")).alias("symbol"), F.explode(contexts).alias("context")).groupBy(
        "context", "verdict", "symbol").agg(F.count("*").alias("n"))
    by_context = own.groupBy("context").agg(F.sum("n").alias("m"), F.collect_list(F.struct("verdict", "symbol", "n")).alias("next"))
    total = sample.agg(F.sum(F.length("url") + 1)).first()[0] or 0
    return {tuple(r.context): {(x.verdict, x.symbol): x.n for x in r.next} for r in by_context.where(F.col("m") * SHARE >= total).collect()}


def automaton(counts: dict[tuple[int, ...], dict[tuple[str, int], int]]) -> tuple[list[int], list[float]]:
    """Moves and gains by state and symbol.  The state after some text is its longest
    end that is a kept context; every start of a kept context is kept, so that is an end
    of the state before with one more symbol."""
    contexts = sorted(counts, key=lambda c: (len(c), c)) or [()]
    state = {c: i for i, c in enumerate(contexts)}
    chances: dict[str, dict[tuple[int, ...], list[float]]] = {}
    for verdict in (ALLOW, BLOCK):
        own = chances[verdict] = {}
        for c in contexts:
            shorter = own[c[1:]] if c else [1 / SYMBOLS] * SYMBOLS
            seen = [counts.get(c, {}).get((verdict, x), 0) for x in range(SYMBOLS)]
            own[c] = [(n + WEIGHT * p) / (sum(seen) + WEIGHT) for n, p in zip(seen, shorter, strict=True)]
    moves, gains = [], []
    for c in contexts:
        for x in range(SYMBOLS):
            longer = (*c, x)
            while longer not in state:
                longer = longer[1:]
            moves.append(state[longer])
            gains.append(round(math.log(chances[ALLOW][c][x]) - math.log(chances[BLOCK][c][x]), 6))
    return moves, gains


def score(url: Column, moves: list[int], gains: list[float]) -> Column:
    """Log-likelihood difference by character."""
    to, by = F.from_json(F.lit(json.dumps(moves)), "array<int>"), F.from_json(F.lit(json.dumps(gains)), "array<double>")
    symbols = _symbols(url)
    start = F.struct(F.lit(0).alias("state"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["state"] * SYMBOLS + x
        return F.struct(F.get(to, at).alias("state"), (acc["sum"] + F.get(by, at)).alias("sum"))

    return F.aggregate(symbols, start, step, lambda acc: acc["sum"]) / (F.length(F.coalesce(url.cast("string"), F.lit(""))) + 1)


def calibrate(scores: dict[tuple[str, float], int]) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the scores, both classes weighing
    the same; 1 and 0 where a class has none."""
    sizes = {v: sum(n for (w, _), n in scores.items() if w == v) for v in (ALLOW, BLOCK)}
    if not all(sizes.values()):
        return 1.0, 0.0
    slope, offset = 1.0, 0.0
    for _ in range(STEPS):
        g = [RIDGE * slope, 0.0]
        h = [[RIDGE, 0.0], [0.0, RIDGE]]
        for (verdict, x), n in scores.items():
            chance = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + offset))))
            weight = n / sizes[verdict]
            error, bend = weight * (chance - (verdict == ALLOW)), weight * chance * (1 - chance)
            g = [g[0] + error * x, g[1] + error]
            h = [[h[0][0] + bend * x * x, h[0][1] + bend * x], [h[1][0] + bend * x, h[1][1] + bend]]
        det = h[0][0] * h[1][1] - h[0][1] * h[1][0]
        slope -= (g[0] * h[1][1] - g[1] * h[0][1]) / det
        offset -= (g[1] * h[0][0] - g[0] * h[1][0]) / det
    return slope, offset


def train(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> Model:
    """The models' difference and its calibration, from what the rules decide."""
    sample = _sample(pages, url, rules)
    counts = _counts(sample.where("NOT held"))
    if {v for v, _ in counts.get((), ())} != {ALLOW, BLOCK}:
        return Model([0] * SYMBOLS, [0.0] * SYMBOLS, 0.0, 0.0)
    moves, gains = automaton(counts)
    held = sample.where("held").select("verdict", F.round(score(F.col("url"), moves, gains), 3).alias("x"))
    slope, offset = calibrate({(r.verdict, r.x): r.n for r in held.groupBy("verdict", "x").agg(F.count("*").alias("n")).collect()})
    return Model(moves, gains, slope, offset)


def with_verdict(pages: DataFrame, out: str, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, model: Model | None = None) -> DataFrame:
    """``pages`` with one more column: a struct of host, path, rule, score and verdict."""
    model = train(pages, url, rules) if model is None else model
    keep, u, n = [F.col(f"`{c}`") for c in pages.columns], F.col(f"`{url}`"), free_name(pages, "__rule")
    host, path = host_and_path(u)
    split = pages.select(*keep, F.struct(host.alias("host"), path.alias("path"), score(u, model.moves, model.gains).alias("score")).alias(n))
    h = F.col(n)
    ruled = split.select(*keep, n, fitting_rule(h["host"], h["path"], rules).alias(n + "_"))
    names, verdicts = (F.array(*map(F.lit, x)) for x in ([a + b for _, a, b in rules], [v for v, _, _ in rules]))
    judged = F.when(model.slope * h["score"] + model.offset < 0, BLOCK).otherwise(ALLOW)
    return ruled.select(*keep, F.struct(h["host"].alias("host"), h["path"].alias("path"), F.get(names, F.col(n + "_")).alias("rule"), h["score"].alias("score"),
                                        F.coalesce(F.get(verdicts, F.col(n + "_")), judged).alias("verdict")).alias(out))


def drop_blocked(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, model: Model | None = None) -> DataFrame:
    """``pages`` without those that are blocked, columns unchanged."""
    out = free_name(pages, "__verdict")
    return with_verdict(pages, out, url, rules, model).where(F.col(out)["verdict"] == ALLOW).drop(out)


def verdict_table(pages: DataFrame) -> DataFrame:
    """One row per page: host, path, the rule that decides, and the verdict."""
    return with_verdict(pages.select("page_id", "url"), "v").select("page_id", "v.host", "v.path", "v.rule", "v.verdict", F.round("v.score", 6).alias("score"))
