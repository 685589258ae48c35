import random
from itertools import combinations

import xxhash

from attrition.llm import simhash_dups as s
from attrition.llm.components import connected_components
from tests.llm.cases import as_set, awkward, awkward_rows, clashing, empty


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(sorted(parent), 2):
        if bin(a ^ b).count("1") <= 2:
            parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(set(fps))
    least = {}
    for (k, _), f in zip(rows, fps, strict=True):
        if k is not None:
            least[root[f]] = min(k, least.get(root[f], k))
    return sorted(((k, f"{f:016x}", least.get(root[f])) for (k, _), f in zip(rows, fps, strict=True)), key=repr)


def test_awkward_rows_match_brute_force(spark):
    assert as_set(s.near_duplicates(awkward(spark))) == brute([(r[0], r[1]) for r in awkward_rows()])


def test_near_copies_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(30):
        body = [f"t{rng.randrange(4000)}" for _ in range(120)]
        for _ in range(rng.randrange(1, 8)):
            w = list(body)
            w[rng.randrange(120)] = "changed"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_set(s.near_duplicates(df))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows)


def components_of(spark, fps, **options):
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    edges = s.links(spark.createDataFrame([(f,) for f in signed], "fp long"), **options)
    pairs = {(r.a % (1 << 64), r.b % (1 << 64)) for r in edges.collect()}
    assert all(bin(a ^ b).count("1") <= 2 for a, b in pairs)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        parent[find(a)] = find(b)
    return {frozenset(g for g in fps if find(g) == find(f)) for f in fps}


def test_short_and_hot_postings_give_the_same_components(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    want_root = brute_components(fps)
    want = {frozenset(g for g in fps if want_root[g] == want_root[f]) for f in fps}
    assert components_of(spark, fps, max_posting=10**9) == want  # pairs only
    assert components_of(spark, fps, max_posting=1) == want  # one-bit variants only
    assert components_of(spark, fps) == want


def test_byte_index_finds_every_pair_within_two_bits(spark):
    base = 0x0123456789ABCDEF
    for a, b in [(0, 1), (0, 8), (7, 63), (62, 63), (16, 48)]:
        pair = {base, base ^ (1 << a) ^ (1 << b)}
        assert components_of(spark, pair) == {frozenset(pair)}
    three = {base, base ^ 0b111}
    assert len(components_of(spark, three)) == 2


def test_tally_of_meetings_chooses_the_candidates(spark):
    """Pairs with 8 - d shared bytes, in every choice of positions: the tally keeps
    those with d of 2 or less and drops the others, which do meet in postings."""
    assert len(s.POSTED) == 14 and [s.min_meetings(d) for d in range(4)] == [14, 7, 3, 1]
    rng = random.Random(8)
    rows, differing = [], {}
    for d in range(1, 6):
        for places in combinations(range(8), d):
            a = rng.getrandbits(64)
            b = a
            for p in places:
                b ^= rng.randrange(1, 256) << (8 * p)
            a, b = (x - (1 << 64) if x >= 1 << 63 else x for x in (a, b))
            rows += [(a,), (b,)]
            differing[max(a, b), min(a, b)] = d
    index = spark.createDataFrame(rows, "fp long").select("fp", s.F.explode(s._postings(s.F.col("fp"))).alias("p"))
    met = {(r.a, r.b): r.meetings for r in s.tally(index.select("fp", "p.way", "p.value")).collect()}
    assert all((met.get(pair, 0) >= 3) == (d <= 2) for pair, d in differing.items())
    assert sum(met.get(pair, 0) == 1 for pair, d in differing.items() if d == 3) == 56
    assert any(met.get(pair, 0) == 1 for pair, d in differing.items() if d == 4)


def test_components_of_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 4000: 4000, 5000: 4000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_of_each(spark):
    docs = clashing(spark, "fp", "key", "component_id", "__key")
    kept = s.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = {}
    rows = awkward_rows()
    root = brute_components({brute_fingerprint(r[1]) for r in rows})
    for r in rows:
        c = root[brute_fingerprint(r[1])]
        want[c] = min((r[0] is None, r[0] or 0), want.get(c, (True, 0)))
    assert sorted((k is None, k or 0) for k, _ in got) == sorted(want.values())


def test_empty_table(spark):
    assert s.near_duplicates(empty(spark)).count() == 0
    assert s.keep_one_of_each(empty(spark)).count() == 0
