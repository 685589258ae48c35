import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from attrition.llm import lm_score as m
from tests.llm.cases import awkward, awkward_rows, clashing, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, mu=m.MU):
    docs = [(k, [*WORD.findall((t or "").translate(LOWER)), "\n"]) for k, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in docs]
    one, two, starts = Counter(), Counter(), 0
    for (_, w), h in zip(docs, held, strict=True):
        if not h:
            starts += 1
            one.update(w)
            two.update(zip(["\n\n", *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    # the automaton, spelled out: arcs, failure arcs and the empty state
    p = lambda x: (one[x] + 1) / (n + v + 1)
    seen = lambda s: starts if s == "\n\n" else one[s]
    arcs = {(a, b): math.log10((c + mu * p(b)) / (seen(a) + mu)) for (a, b), c in two.items()}
    out = []
    for (k, w), h in zip(docs, held, strict=True):
        state, total = "\n\n" if starts else None, 0.0
        for x in w:
            if (state, x) in arcs:
                total += arcs[state, x]
            else:
                if state is not None:
                    total += math.log10(mu / (seen(state) + mu))
                total += math.log10(p(x))
            state = x if one[x] else None
        out.append((k, h, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), total))
    return sorted(out, key=lambda r: (repr(r[0]), r[6]))


def check(df, rows, **options):
    got = sorted((tuple(r) for r in m.lm_scores(df, **options).collect()), key=lambda r: (repr(r[0]), r[6]))
    want = brute(rows)
    assert [g[:5] for g in got] == [x[:5] for x in want]
    assert all(g[5] == pytest.approx(x[5], abs=1e-7) and g[6] == pytest.approx(x[6], abs=1e-7) for g, x in zip(got, want, strict=True))


def test_awkward_rows_match_brute_force(spark):
    check(awkward(spark), [(r[0], r[1]) for r in awkward_rows()])


def test_many_blocks_and_buckets_give_the_same(spark):
    rows = [(i, " ".join(f"v{(i * j * j) % (5 + j % 11)}" for j in range(i % 60))) for i in range(150)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, block_words=200, bucket_bytes=2000)


def test_segments_and_one_pass_give_the_same():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 700, 3, 64, 65, 200])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(2, 30, starts[-1]).astype(np.int32)
    ids[starts[1:] - 1] = 1
    held = np.array([False, True, False, True, False, False])
    block = m.Block(rng.integers(1, 2**63, 30).astype(np.uint64), ids, starts, held)
    _, order = block.words()
    auto = m.Automaton(block, block.word_counts()[order], block.pair_counts(), 1000, 25)
    whole = auto.walk(10**6)
    state, plain = 0, []
    for i, w in enumerate(ids):
        if i in starts:
            state = auto.state_of[0]
            plain.append(0.0)
        nxt, weight = auto.step(np.array([state]), np.array([w], np.int64))
        state = nxt[0]
        plain[-1] += weight[0]
    assert np.allclose(whole, plain)
    for n in (1, 2, 64, 512):
        assert np.allclose(auto.walk(n), whole)


def test_nothing_to_train_on(spark):
    held = [k for k in range(100) if m.is_held_out(k)][:3]
    rows = [(k, "a b") for k in held]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_arcs_of_a_state_sum_to_one():
    one, two = Counter("abcab\n"), Counter(zip("abcab", "bcab\n", strict=False))
    n, v = sum(one.values()), len(one)
    p = {x: (one[x] + 1) / (n + v + 1) for x in one}
    p["unknown"] = 1 / (n + v + 1)
    for s in "abc":
        total = sum((two[s, x] + m.MU * p[x]) / (one[s] + m.MU) for x in p)
        assert total == pytest.approx(1)


def test_array_coding_round_trip():
    rng = np.random.default_rng(0)
    for a in (np.zeros(0, "<u4"), rng.integers(0, 9, 1000).astype("<u4")):
        assert (m.unsqueeze(m.squeeze(a), "<u4") == a).all()
    for a in (np.zeros(0, np.uint64), np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))):
        assert (m.unsqueeze_sorted(m.squeeze_sorted(a)) == a).all()


def test_clashes_and_empty(spark):
    assert m.lm_scores(clashing(spark, "block", "ids", "score", "key")).count() == len(awkward_rows())
    assert m.lm_scores(empty(spark)).collect() == []
