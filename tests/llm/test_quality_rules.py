import re
from collections import Counter

from attrition.llm import quality_rules as q
from tests.llm.cases import as_set, awkward, awkward_rows, clashing, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force_on_awkward_rows(spark):
    got = as_set(q.quality_table(awkward(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert got == sorted(((r[0], *brute(r[1])) for r in awkward_rows()), key=repr)


def test_repeats_overlap_and_run(spark):
    texts = ["a b c a b c", "x x x x", "a b c d a b c d e f a b", "p q r s p q r", "a b", "a b c\na b c\n\nz\nz\nz", "k " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.quality_table(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_policy_and_base(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, clean), (2, "short"), (3, " ".join(["a b c"] * 30)), (4, clean.replace(" ", "### ")), (5, clean.upper()), (6, clean.replace(" ", "!! "))]
    got = {r.doc_id: (r.base_failed, r.kept) for r in q.quality_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (False, False), 6: (False, False)}


def test_ablation_counts_match_a_second_evaluation(spark):
    rows = [(i, b) for i, b in enumerate([0, 1, 2, 3, 4, 0b100100, 0b11100000, 0b01100000, 0b10000000])]
    bits = spark.createDataFrame(rows, "doc_id long, fail_bits long")
    got = {(r.policy, r.rule): (r.n_fail, r.n_rejected, r.n_kept_without) for r in q.ablations(bits).collect()}
    for version, p in q.POLICIES.items():
        def out(b, without=None, p=p):
            hard = q.rule_mask([x for x in p.reject if x != without])
            soft = q.rule_mask([x for x in p.vote if x != without])
            return bool(b & hard) or bool(soft) and bin(b & soft).count("1") >= p.votes
        for i, rule in enumerate(q.RULES):
            fails = sum(b >> i & 1 for _, b in rows)
            rejects = sum(out(b) for _, b in rows)
            only = sum(out(b) and not out(b, rule.name) for _, b in rows)
            assert got[version, rule.name] == (fails, rejects, only)


def test_filter_keeps_columns_and_survives_clashes(spark):
    docs = clashing(spark, "n_words", "kept", "__ledger", "__words", "fail_bits")
    kept = q.filter_by_policy(docs)
    assert kept.columns == docs.columns
    # sixty or more different words; the long text, and all rows of the body
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 2, 2, 6, None]


def test_empty_table(spark):
    assert q.quality_table(empty(spark)).count() == 0
    assert q.filter_by_policy(empty(spark)).count() == 0
    assert q.ablations(q.quality_table(empty(spark))).count() == 0


def test_plan_is_native_and_without_shuffle(spark):
    plan = q.quality_table(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_windows_of_equal_hash_bits_are_told_apart_by_their_words(spark):
    """Two windows whose hashes agree in the bits that a text of 600,000 words leaves."""
    words = [f"u{i}" for i in range(600_000)]
    words[100:103], words[300_000:300_003] = ["k5940854", "x", "y"], ["k12172494", "x", "y"]
    row = q.quality_table(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (row.n_words, row.n_repeat_words) == (600_000, 0)
    words[400_000:400_003] = ["k5940854", "x", "y"]
    row = q.quality_table(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert row.n_repeat_words == 6
