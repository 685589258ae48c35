import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from attrition.llm import periodic_runs as pr
from tests.llm.cases import awkward, awkward_rows, clashing, empty, words

SF = "/root/testdata/sf0.01"


def all_runs(w):
    """(start, period, length) of all runs, comparing every pair of words a period apart."""
    number = {}
    ids = np.array([number.setdefault(x, len(number)) for x in w], dtype=np.int64)
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(int), [0]])
        edge = np.nonzero(np.diff(same))[0]
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i + q >= max(6, 4 * q):
                if not any(a <= i and j + q <= a + size for a, g, size in out if q % g == 0):
                    out.append((i, q, j - i + q))
    return sorted(out)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def hurt(key, w):
    if key is None:
        return w
    h, n = zlib.crc32(str(key).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def collapse(w, runs):
    gone = np.zeros(len(w) + 1, int)
    for a, q, size in runs:
        gone[a + q:a + size] = 1
    return " ".join(x for x, g in zip(w, gone) if not g)


def brute(rows):
    out = []
    for key, text in rows:
        w = hurt(key, split(text))
        runs = all_runs(w)
        best = (None,) * 4
        if runs:
            a, q, size = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]))
            best = (a, size, q, 1000 * size // q)
        lines = "".join(f"{a},{size},{q}\n" for a, q, size in runs)
        out.append((key, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(w, runs).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, pr.runs_table(df).collect()), key=repr)


def made_texts(rng):
    """Texts with runs of many periods, nested, touching, and at both ends."""
    texts = ["x " * n for n in (1, 5, 6, 7, 40, 300)] + ["a b " * n for n in (2, 3, 4, 50)]
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            root = words(rng, rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100]), rng.choice([2, 3, 50]))
            size = int(len(root) * rng.choice([1, 2.5, 3.9, 4, 4, 4.3, 6, 11]))
            parts += (root * 12)[:size] + words(rng, rng.choice([0, 0, 1, 5, 40]), 3)
        texts.append(" ".join(parts))
    inner = ("a a a a a a b " * 9 + "c ") * 6
    return [*texts, inner, inner + "a b", "\n".join(["same line here"] * 30)]


@pytest.fixture(scope="module")
def texts():
    return made_texts(random.Random(11))


def test_matches_brute_force(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q " * 9), (3, texts[12]), (3, texts[12])]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    found = got(spark.read.parquet(f"{SF}/documents.parquet"))
    assert found == brute(rows)
    assert sum(r[1] > 0 for r in found) > 40


def test_long_text_over_many_tiles(spark):
    """Stitched over hundreds of tiles, and over stretches of tiles."""
    rng = random.Random(3)
    root = words(rng, 37, 10 ** 6)
    w = words(rng, 5001, 10 ** 6) + (root * 700)[:25_000] + words(rng, 3000, 10 ** 6) + ["z"] * 9000 + ["y", "z"] * 3000
    old, pr._STRETCH = pr._STRETCH, 3
    try:
        out = pr.periodic_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    finally:
        pr._STRETCH = old
    end = 33_001 + 9000
    assert [tuple(r) for r in out.runs] == [(5001, 37, 25_000), (33_001, 1, 9000), (end - 1, 2, 6001)]
    assert out.text == collapse(w, [tuple(r) for r in out.runs])


def test_tiles_without_marks_are_never_needed(texts):
    """All boundaries marked finds nothing that the window hashes leave out."""
    for t in texts[:60]:
        number = {}
        ids = np.array([number.setdefault(x, len(number)) for x in t.split()], dtype=np.int32)
        made = {f for _, tile in pr.tiles_of(ids, np.array([0, len(ids)])) for f in pr.solve(tile)}
        p, every = 1, set()
        while 4 * p <= len(ids):
            for core in range(0, len(ids), 8 * p):
                low = max(0, core - p)
                bits = sum(1 << k for k in range(8) if core + k * p + 3 * p <= len(ids))
                every |= set(pr.solve((p, low, core, bits, ids[low:core + 15 * p])))
            p *= 2
        assert {f for f in every if f[2] - f[1] >= max(6, 4 * f[0])} <= {f for f in made}


def test_awkward_rows(spark):
    rows = [r[:2] for r in awkward_rows()]
    assert got(awkward(spark)) == brute(rows)
    assert got(clashing(spark, "key", "rid", "h", "w", "n", "a", "p", "runs")) == brute(rows)
    assert pr.runs_table(empty(spark)).count() == 0
