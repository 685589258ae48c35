from attrition.llm import line_spread as ls
from tests.llm.cases import awkward, clashing, empty


def brute(rows, least):
    """rows: (doc_id, text, source)."""
    sites, first = {}, {}
    for k, t, s in rows:
        for x in (t.split("\n") if t is not None else []):
            if x.strip(" \t\n\x0b\x0c\r"):
                sites.setdefault(x, set()).update([s] if s is not None else [])
                if k is not None:
                    first[x] = min(k, first.get(x, k))
    out = []
    for k, t, _ in rows:
        if t is None:
            out.append((k, None))
            continue
        left, seen = [], set()
        for x in t.split("\n"):
            bad = x.strip(" \t\n\x0b\x0c\r") and len(sites[x]) >= least
            if not bad or (first.get(x) == k and x not in seen):
                left.append(x)
            seen.add(x)
        out.append((k, "\n".join(left)))
    return sorted(out, key=repr)


ROWS = [(i, f"own line {i}\nshared on all\n\nshared on few {i % 3}\nshared on all", f"s{i}") for i in range(12)] + [
    (100, "shared on all", None), (101, "shared on all\nshared on all", "s1"), (102, None, "s1"), (103, "", None),
    (None, "shared on all\nnull id", "s2"), (5, "shared on all\nsame id, other text", "s3"), (104, "nul\x00 line", "s4")]


def test_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for least in (2, 4, 5, 12, 13):
        got = sorted(((r.doc_id, r.text) for r in ls.drop_boilerplate(df, least).collect()), key=repr)
        assert got == brute(ROWS, least), least


def test_near_threshold_lines_are_counted_exactly(spark):
    """A coarse sketch (32 registers) over hundreds of sites must not decide."""
    rows = [(i, "at the threshold", f"s{i}") for i in range(300)] + [(1000 + i, "one below", f"s{i}") for i in range(299)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in ls.drop_boilerplate(df, 300, lg_k=5).collect()}
    assert [k for k, t in got.items() if t == "at the threshold"] == [0]
    assert all(got[1000 + i] == "one below" for i in range(299))


def test_columns_clashes_and_empty(spark):
    docs = clashing(spark, "key", "pos", "__gone", "__cut", "h1")
    out = ls.drop_boilerplate(docs, 2, removed="n_removed")
    assert out.columns == [*docs.columns, "n_removed"] and out.count() == docs.count()
    assert ls.drop_boilerplate(empty(spark), 2).count() == 0
    assert ls.drop_boilerplate(awkward(spark), 1).where("doc_id = 6").first().text.count("\n") == 899


def test_removed_lines_of_a_repeated_row_count_once(spark):
    rows = [(i, f"own {i}\nshared\nshared", f"s{i}") for i in range(1, 5)] + [(2, "own 2\nshared\nshared", "s2")]
    got = ls.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), 3, removed="n").collect()
    assert sorted((r.doc_id, r.n, r.text) for r in got) == [(1, 1, "own 1\nshared"), (2, 2, "own 2"), (2, 2, "own 2"), (3, 2, "own 3"), (4, 2, "own 4")]
