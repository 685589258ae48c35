from collections import Counter

import random

from attrition.llm import decontam as d
from tests.llm.cases import awkward, awkward_rows, clashing, empty

ITEMS = "item_id long, text string, items string"


def brute(docs, items, window=13):
    windows = {}
    for k, t in items:
        w = d.item_words(t.encode() if t is not None else None)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if k is None else str(k))
    out = []
    for k, t in docs:
        w = d.item_words(t.encode() if t is not None else None)
        hit, names = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i:i + size]))
                if found:
                    hit.update(range(i, i + size))
                    names |= found
        out.append((k, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def got(df, items, **options):
    return sorted(((r.key, r.n_words, r.n_hit, list(r["items"])) for r in d.contamination(df, items, **options).collect()), key=repr)


def planted():
    rng = random.Random(1)
    items = [(i, " ".join(f"q{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 5, 12, 13, 14, 40])))) for i in range(40)]
    items += [(7, items[7][1]), (None, "null id item of five"), (99, None), (98, "Ünï-Cödé; punctuation, SPLITS words")]
    docs = []
    for i in range(120):
        w = [f"q{rng.randrange(60)}" if rng.random() < 0.5 else f"n{rng.randrange(900)}" for _ in range(rng.randrange(300))]
        for _ in range(rng.randrange(3)):
            source = (rng.choice(items)[1] or "").split()
            if source:
                a = rng.randrange(len(source))
                w[5:5] = source[a:a + rng.randrange(1, 30)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).replace("q1", "Q1")))
    return docs + [(500, "ünï cödé"), (501, "x ünï CöDé punctuation splits words null id item of five"), (None, items[9][1])], items


def test_planted_passages_match_brute_force(spark):
    docs, items = planted()
    bench = spark.createDataFrame([(*x, "own") for x in items], ITEMS)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df, bench) == brute(docs, items)


def test_small_segments_and_blocks_of_items_give_the_same(spark):
    docs, items = planted()
    bench = spark.createDataFrame([(*x, "own") for x in items], ITEMS)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = d.build_index(df, segment_words=300)
    assert index.count() > 10
    found = d.search_index(index, bench, block_bytes=500)
    listed = index.select("segment", d.F.posexplode("docs").alias("ord", "d")).select("segment", "ord", "d.*").join(found, ["segment", "ord"], "left")
    mine = sorted(((r.key, r.n_words, len(r.words or []), sorted(r["items"] or [])) for r in listed.collect()), key=repr)
    assert mine == brute(docs, items)


def test_awkward_rows_clashes_and_empty(spark):
    bench = spark.createDataFrame([(1, "one", "own"), (2, "words x", "own")], ITEMS)
    want = brute([(r[0], r[1]) for r in awkward_rows()], [(1, "one"), (2, "words x")])
    assert got(awkward(spark), bench) == want
    assert got(clashing(spark, "segment", "terms", "key", "items"), bench) == want
    assert all(x[2:] == (0, []) for x in got(awkward(spark), bench.limit(0)))
    assert got(empty(spark), bench) == []


def test_rule_and_filter(spark):
    item = " ".join(f"b{i}" for i in range(20))
    docs = [(1, item), (2, item + " pad" * 380), (3, item + " pad" * 381), (4, "clean"), (None, item), (5, None)]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, item, "own")], ITEMS)
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_proximity(spark):
    docs = [(1, "alpha x x beta x gamma"), (2, "gamma beta alpha"), (3, "alpha x x x x x x x beta gamma"), (4, "alpha beta")]
    index = d.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    bench = spark.createDataFrame([(1, "alpha beta gamma", "own")], ITEMS)
    near = d.search_index(index, bench, slack=3).where("size(near) > 0")
    names = index.select("segment", d.F.posexplode("docs").alias("ord", "d")).select("segment", "ord", "d.key")
    assert sorted(r.key for r in names.join(near, ["segment", "ord"]).collect()) == [1, 2]


def test_table_counts_items_by_proximity(spark):
    words = [f"b{i}" for i in range(13)]
    item, put_in = " ".join(words), " ".join([*words[:6], "extra", *words[6:]])
    moved, apart = " ".join([*words[1:], words[0]]), " ".join([*words[:6], *["pad"] * 30, *words[6:]])
    df = spark.createDataFrame(list(enumerate([item, put_in, moved, apart, "clean", None])), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item, "own"), (2, item + " tail", "own")], ITEMS)
    rows = {r.doc_id: r for r in d.contamination_table(df, bench).collect()}
    assert [rows[k].n_near_items for k in range(6)] == [2, 2, 2, 0, 0, 0]
    assert [rows[k].n_items for k in range(6)] == [2, 0, 0, 0, 0, 0]


def test_proximity_matches_brute_force(spark):
    docs, items = planted()
    docs = [*docs, (9001, "a cat saw the dog"), (9002, "the cat the dog the the"), (9003, "the the x the the y z cat")]
    items = [*items, (9001, "the the the the cat")]
    bench = spark.createDataFrame([(*x, "own") for x in items], ITEMS)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for slack in (0, 2, d.SLACK):
        want = {}
        for k, t in docs:
            w, names = d.item_words(t.encode() if t is not None else None), set()
            for item, text in items:
                v = d.item_words(text.encode() if text is not None else None)
                size = min(d.WINDOW, len(v))
                for i in range(len(v) - size + 1 if v else 0):
                    need = Counter(v[i:i + size])
                    if any(need <= Counter(w[p:p + size + slack]) for p in range(len(w)) if w[p] in need):
                        names.add("" if item is None else str(item))
            want.setdefault(k, []).append(sorted(names))
        rows = d.contamination(df, bench, slack=slack).collect()
        got = {}
        for r in rows:
            got.setdefault(r.key, []).append(list(r.near_items))
            assert set(r["items"]) <= set(r.near_items)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
