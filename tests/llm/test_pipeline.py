from collections import defaultdict

import pytest

import corpus_pipeline as cp
from attrition.sources.tables import read_table
from tests.llm import test_decontam, test_line_spread, test_quality_rules, test_simhash_dups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, over all that its predecessor kept."""
    docs, out = read_table(spark, SF, "documents"), []
    for _, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def test_stages_match_brute_force(spark, stages):
    rows = [tuple(r) for r in read_table(spark, SF, "documents").collect()]

    def clean(t):
        n, _, _, _, rep = test_quality_rules.brute(t)
        letters = sum(c.isascii() and c.isalpha() for c in t)
        caps = sum("A" <= c <= "Z" for c in t)
        lines = [x for x in t.split("\n") if test_quality_rules.WORD.search(x)]
        symbols, chars = sum(c in "#*$%&|<>" for c in t), sum(map(len, test_quality_rules.WORD.findall(t)))
        votes = (100 * (len(lines) - len(set(lines))) > 30 * len(lines)) + (100 * sum("0" <= c <= "9" for c in t) > 20 * len(t)) + (
            chars > 12 * n or 2 * chars < 5 * n)
        return not (n < 50 or 100 * rep > 50 * n or 10 * symbols > n or 10 * t.count("!") > n or 100 * caps > 50 * letters or votes >= 2)

    rows = [r for r in rows if clean(r[1])]
    assert sorted(r.doc_id for r in stages[0].collect()) == sorted(r[0] for r in rows)

    left = dict(test_line_spread.brute([(r[0], r[1], r[3]) for r in rows], 10))
    rows = [(r[0], left[r[0]], r[2], r[3], len(left[r[0]])) for r in rows]
    assert sorted(map(tuple, stages[1].collect())) == sorted(rows)

    best = {c for _, _, c in test_simhash_dups.brute([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if r[0] in best]
    assert sorted(map(tuple, stages[2].collect())) == sorted(rows)

    items = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = {k for k, n, hit, _ in test_decontam.brute([(r[0], r[1]) for r in rows], items) if hit and 20 * hit >= n}
    rows = [r for r in rows if r[0] not in bad]
    assert sorted(map(tuple, stages[3].collect())) == sorted(rows)

    tokens, bins = defaultdict(int), defaultdict(int)
    for r in stages[4].collect():
        tokens[r.doc_id] += r.length
        bins[r.sequence_id] += r.length
    assert sorted(tokens) == sorted(r[0] for r in rows)
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(tokens.values()) // 2048) * 1.05 + 1


def test_columns_between_stages(spark, stages):
    want = read_table(spark, SF, "documents").columns
    assert [s.columns for s in stages[:4]] == [want] * 4
