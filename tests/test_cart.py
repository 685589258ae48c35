"""Exact trees: splits against a plain search, attributions against Shapley's definition."""

import math
import random
from itertools import combinations

import pytest

from attrition.operators import cart

FEATS = ["a", "b", "c"]


def _rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.randrange(12), rng.choice([None, *range(6)]), round(rng.gauss(0, 1), 1)
        out.append((i, float(a), None if b is None else float(b), c, int(a + 3 * c + rng.gauss(0, 2) > 6)))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int")


def _grow(rows, p):
    """{node: (feature, threshold)} and {node: (n, n1)} by trying every cut of every node."""
    low = float("-inf")
    w0, w1 = p.class_weight

    def imp(rs):
        a, b = w0 * sum(r[4] == 0 for r in rs), w1 * sum(r[4] == 1 for r in rs)
        return 2 * a * b / (a + b)

    splits, nodes, todo = {}, {}, [(1, 0, rows)]
    while todo:
        node, depth, rs = todo.pop()
        n1 = sum(r[4] for r in rs)
        nodes[node] = (len(rs), n1)
        if depth == p.max_depth or len(rs) < p.min_samples_split or n1 in (0, len(rs)):
            continue
        options = []
        for f in range(3):
            x = [low if r[1 + f] is None else r[1 + f] for r in rs]
            values = sorted(set(x))
            for v, after in zip(values, values[1:], strict=False):
                left = [r for r, e in zip(rs, x, strict=True) if e <= v]
                right = [r for r, e in zip(rs, x, strict=True) if e > v]
                if min(len(left), len(right)) >= p.min_samples_leaf:
                    mid = v if v == low else v + (after - v) / 2
                    options.append((-round(imp(rs) - imp(left) - imp(right), 9), f, v, mid, left, right))
        if options:
            _, f, _, mid, left, right = min(options, key=lambda o: o[:3])
            splits[node] = (f, mid)
            todo += [(2 * node, depth + 1, left), (2 * node + 1, depth + 1, right)]
    return splits, nodes


@pytest.mark.parametrize("p", [cart.Cart(max_depth=4, min_samples_leaf=3), cart.Cart(max_depth=3, min_samples_split=40, class_weight=(1.0, 8.61))])
def test_splits_match_a_plain_search(spark, p):
    rows = _rows(160)
    splits, nodes = cart.fit(_frame(spark, rows), "id", FEATS, "y", p)
    want, counts = _grow(rows, p)
    assert {r.node: (r.f, r.threshold) for r in splits.collect()} == want
    assert {r.node: (r.n, r.n1) for r in nodes.collect()} == counts


def test_scores_and_attributions_match_their_definitions(spark):
    rows = _rows(120, 2)
    df = _frame(spark, rows)
    p = cart.Cart(max_depth=4, min_samples_leaf=4, class_weight=(1.0, 2.0))
    model = cart.fit(df, "id", FEATS, "y", p)
    splits, nodes = _grow(rows, p)
    weight = {k: (n - n1) + 2.0 * n1 for k, (n, n1) in nodes.items()}

    def worth(x, inside, node=1):
        if node not in splits:
            return 2.0 * nodes[node][1] / weight[node]
        f, t = splits[node]
        if f in inside:
            return worth(x, inside, 2 * node + (not x[f] <= t))
        return sum(weight[c] * worth(x, inside, c) for c in (2 * node, 2 * node + 1)) / weight[node]

    scores = {r.id: r.prob for r in cart.score(df, FEATS, model, p).collect()}
    got = {(r.id, r.feature): (r.attribution, r.base) for r in cart.tree_attribution(df, "id", FEATS, model, p).collect()}
    assert len(got) == 3 * len(rows)
    for r in rows:
        x = [float("-inf") if e is None else e for e in r[1:4]]
        assert scores[r[0]] == pytest.approx(worth(x, {0, 1, 2}))
        for i, name in enumerate(FEATS):
            others = [j for j in range(3) if j != i]
            phi = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (worth(x, {*s, i}) - worth(x, {*s}))
                      for k in range(3) for s in combinations(others, k))
            assert got[r[0], name] == (pytest.approx(phi, abs=1e-12), pytest.approx(worth(x, set())))


def test_forest_attributions_add_up(spark):
    df = _frame(spark, _rows(100, 3))
    p = cart.Cart(max_depth=3, max_features=2, trees=4, bootstrap=True)
    model = cart.fit(df, "id", FEATS, "y", p)
    assert {r.tree for r in model[0].select("tree").distinct().collect()} == set(range(4))
    scores = {r.id: r.prob for r in cart.score(df, FEATS, model, p).collect()}
    total = {}
    for r in cart.tree_attribution(df, "id", FEATS, model, p).collect():
        total[r.id] = total.get(r.id, r.base) + r.attribution
    assert total == {k: pytest.approx(v) for k, v in scores.items()}


def test_nothing_to_split(spark):
    df = _frame(spark, [(i, 1.0, None, 2.0, i % 2) for i in range(9)])
    p = cart.Cart()
    splits, nodes = cart.fit(df, "id", FEATS, "y", p)
    assert splits.count() == 0 and [(r.n, r.n1) for r in nodes.collect()] == [(9, 4)]
    assert {round(r.prob, 9) for r in cart.score(df, FEATS, (splits, nodes), p).collect()} == {round(4 / 9, 9)}
    empty = df.where("y > 5")
    splits, nodes = cart.fit(empty, "id", FEATS, "y", p)
    assert splits.count() == nodes.count() == 0
    assert {r.prob for r in cart.score(df, FEATS, (splits, nodes), p).collect()} == {None}
