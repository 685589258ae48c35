"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document.  The ledger keeps the measurements
and one long whose bit *i* says that rule *i* failed.  Policies are versioned
sets of bits applied to that long, so a new policy, or the effect of leaving a
rule out, needs no second look at the texts.

Defined results: a null text has no words (all counts 0); empty texts likewise;
repeated rows and null ids each keep their own row; an empty table gives an
empty ledger.  All columns of the input stay, whatever their names."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import WORD, free_name, words


@dataclass(frozen=True)
class Rule:
    """``failed`` builds the condition from a measurement getter."""
    name: str
    failed: object


@dataclass(frozen=True)
class Policy:
    """A document is rejected if a ``reject`` rule failed, or at least ``votes``
    of the ``vote`` rules did."""
    version: str
    reject: tuple[str, ...]
    vote: tuple[str, ...] = ()
    votes: int = 2


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_chars", "n_exclaims", "n_capitals", "n_letters", "n_digits")

#: Bit i of the ledger is rule i; append only, so that stored ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("too_short", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbol_heavy", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("exclaim_heavy", lambda m: 10 * m("n_exclaims") > m("n_words")),
    Rule("shouting", lambda m: 100 * m("n_capitals") > 50 * m("n_letters")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
    Rule("digit_heavy", lambda m: 100 * m("n_digits") > 20 * m("n_chars")),
    Rule("word_length", lambda m: (m("word_chars") > 12 * m("n_words")) | (2 * m("word_chars") < 5 * m("n_words"))),
)

POLICIES: dict[str, Policy] = {p.version: p for p in (
    Policy("base", ("too_short", "repeated_windows")),
    Policy("v1", ("too_short", "repeated_windows", "symbol_heavy", "exclaim_heavy", "shouting"),
           ("repeated_lines", "digit_heavy", "word_length"), 2),
    Policy("strict", tuple(r.name for r in RULES)),
)}


def rule_mask(names: Iterable[str], rules: tuple[Rule, ...] = RULES) -> int:
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[n] for n in set(names))


def _kept_chars(text: Column, others: str) -> Column:
    """How many characters remain when runs of ``others`` are removed."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def with_ledger(docs: DataFrame, out: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with one more column ``out``: a struct of the measurements and
    ``fail_bits``.

    Repeated windows: all 3-word windows are hashed to 64 bits, the position
    takes the low bits (as many as the text needs), and one primitive sort
    brings equal windows together: no rows are exploded and nothing is
    shuffled.  The windows so found are then sorted by their words, and only
    those with equal words count, so the count is exact at any length."""
    t, w, h, s, low, c, d, m = (free_name(docs, f"__{x}") for x in ("text", "words", "win", "sorted", "low", "cand", "dups", "meas"))
    keep = [F.col(f"`{c}`") for c in docs.columns]
    step = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(t))
    step = step.select(*keep, t, words(F.col(t)).alias(w))
    third = F.greatest(F.size(w) - 2, F.lit(0))
    step = step.select(
        *keep, t, w,
        F.transform(F.slice(w, 1, third), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))).alias(h),
        (F.expr(f"shiftleft(1L, cast(ceil(log2(size(`{w}`) + 2)) as int))") - 1).alias(low))
    step = step.select(*keep, t, w, low, F.sort_array(F.transform(
        h, lambda x, i: x.bitwiseAND(F.bitwise_not(F.col(low))).bitwiseOR(i.cast("long")))).alias(s))

    def same(a: Column, b: Column) -> Column:
        return a.bitwiseXOR(b) <= F.col(low)

    def twin(x: Column, i: Column) -> Column:
        def near(k: Column) -> Column:
            y = F.get(s, k)
            return y.isNotNull() & (x.bitwiseXOR(y) >= 0) & same(x, y)
        return near(i - 1) | near(i + 1)

    def by_words(x: Column) -> Column:
        i = x.bitwiseAND(F.col(low)).cast("int")
        return F.struct(*[F.get(w, i + k).alias(f"w{k}") for k in range(3)], i.cast("long").alias("i"))

    step = step.select(*keep, t, w, F.sort_array(F.transform(F.filter(s, twin), by_words)).alias(c))

    def equal(x: Column, i: Column) -> Column:
        def near(k: Column) -> Column:
            y = F.get(c, k)
            return y["w0"].eqNullSafe(x["w0"]) & y["w1"].eqNullSafe(x["w1"]) & y["w2"].eqNullSafe(x["w2"])
        return near(i - 1) | near(i + 1)

    step = step.select(*keep, t, w, F.transform(F.filter(c, equal), lambda x: x["i"]).alias(d))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    covered = F.array_union(F.array_union(F.col(d), F.transform(d, lambda x: x + 1)), F.transform(d, lambda x: x + 2))
    # exploding one struct keeps a filter on the ledger from being pushed, and its
    # expressions copied, into the steps above
    step = step.select(*keep, F.explode(F.array(F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _kept_chars(F.col(t), r"[^#*$%&|<>]+").alias("n_symbols"),
        F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.length(t).cast("long").alias("n_chars"),
        _kept_chars(F.col(t), r"[^!]+").alias("n_exclaims"),
        _kept_chars(F.col(t), r"[^A-Z]+").alias("n_capitals"),
        _kept_chars(F.col(t), r"[^A-Za-z]+").alias("n_letters"),
        _kept_chars(F.col(t), r"[^0-9]+").alias("n_digits"),
    ))).alias(m))

    def got(name: str) -> Column:
        return F.col(m)[name]

    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.failed(got), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return step.select(*keep, F.struct(*[got(x).alias(x) for x in MEASURES], bits.alias("fail_bits")).alias(out))


def rejected(bits: Column, policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """The policy's verdict from the ledger's bits alone."""
    out = bits.bitwiseAND(F.lit(rule_mask(policy.reject, rules)).cast("long")) != 0
    if policy.vote:
        out = out | (F.bit_count(bits.bitwiseAND(F.lit(rule_mask(policy.vote, rules)).cast("long"))) >= policy.votes)
    return out


def filter_by_policy(docs: DataFrame, version: str = "v1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, columns unchanged."""
    led = free_name(docs, "__ledger")
    got = with_ledger(docs, led, text)
    return got.where(~rejected(F.col(led)["fail_bits"], POLICIES[version])).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablations(bits: DataFrame, versions: Iterable[str] = tuple(POLICIES), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule: how many documents fail the rule, how many the
    policy rejects, and how many more it would keep without that rule.

    ``bits`` has the column ``fail_bits``.  It is first counted by distinct
    value (at most 2^rules rows), so the ledger is read once for all policies."""
    counted = bits.groupBy("fail_bits").agg(F.count("*").alias("n"))
    b = F.col("fail_bits")
    pairs = []
    for v in versions:
        p = POLICIES[v]
        for r in rules:
            less = Policy(v, tuple(x for x in p.reject if x != r.name), tuple(x for x in p.vote if x != r.name), p.votes)
            bit = b.bitwiseAND(F.lit(rule_mask([r.name], rules)).cast("long")) != 0
            pairs.append(F.struct(
                F.lit(v).alias("policy"), F.lit(r.name).alias("rule"), bit.alias("fails"),
                rejected(b, p, rules).alias("rejects"),
                (rejected(b, p, rules) & ~rejected(b, less, rules)).alias("only")))
    each = counted.select("n", F.explode(F.array(*pairs)).alias("x"))

    def tally(c: str) -> Column:
        return F.sum(F.when(F.col(f"x.{c}"), F.col("n")).otherwise(0))

    return each.groupBy(F.col("x.policy").alias("policy"), F.col("x.rule").alias("rule")).agg(
        tally("fails").alias("n_fail"), tally("rejects").alias("n_rejected"), tally("only").alias("n_kept_without"))


def quality_table(docs: DataFrame, version: str = "v1") -> DataFrame:
    """One row per document: measurements, bits and verdicts."""
    led = with_ledger(docs.select("doc_id", "text"), "led")
    b = F.col("led.fail_bits")
    return led.select(
        "doc_id", *[F.col(f"led.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        rejected(b, POLICIES["base"]).alias("base_failed"),
        (~rejected(b, POLICIES["base"]) & ~rejected(b, POLICIES[version])).alias("kept"),
        b.alias("fail_bits"))


