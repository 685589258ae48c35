import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from attrition.llm import url_filter as uf

SF = "/root/testdata/sf0.1"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SCHEMA = "page_id long, url string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


@pytest.fixture(scope="module")
def urls():
    return duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall()


ODD = ["http://Example.ORG/es/x", "http://example.org", "http://example.org?x=/es/", "http://a.b.org/", "https://notorg/", "x://EXAMPLE.org/en/1?q", "no scheme.org/", "",
       None, "a://b://c.com/de/x", "http://sub.example.org/en/12#f", "http://com/fr/", "://com/de/\n?", "http://xcom/de/", "http://é.com/FR/", "http://user@h.com:80/de/",
       "http://org/es/", "http://example.orG/en/2", "http://net/" + "ä😀" * 3]


def test_hosts_paths_and_rules(spark, urls):
    rows = [*urls, *enumerate(ODD)]
    out = uf.verdict_table(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in out), key=repr)
    want = []
    for k, u in rows:
        want.append((k, *parts(u), rule(*parts(u))[0]))
    assert got == sorted(want, key=repr)
    for r in out:
        if r.rule:
            assert r.verdict == rule(r.host, r.path)[1]


def slow_score(url, counts):
    """Log-likelihood difference by backing off over strings, without states."""
    codes = [uf.ALPHABET.find(c) + 1 for c in url or ""] + [uf.END]

    def chance(verdict, context, x):
        if context not in counts:
            return chance(verdict, context[1:], x)
        below = chance(verdict, context[1:], x) if context else 1 / uf.SYMBOLS
        seen = {s: n for (v, s), n in counts[context].items() if v == verdict}
        return (seen.get(x, 0) + uf.WEIGHT * below) / (sum(seen.values()) + uf.WEIGHT)

    total = 0.0
    for i, x in enumerate(codes):
        before = tuple(codes[max(0, i - uf.ORDER):i])
        total += math.log(chance("allow", before, x)) - math.log(chance("block", before, x))
    return total / len(codes)


def test_scores_match_models_without_automaton(spark, urls):
    df = spark.createDataFrame([*urls, *enumerate(ODD)], SCHEMA)
    sample = uf._sample(df, "url", uf.RULES).cache()
    counts = uf._counts(sample.where("NOT held"))
    assert 50 < len(counts) <= 1 + uf.ORDER * uf.SHARE
    own, total = {}, 0
    for r in sample.where("NOT held").collect():
        codes = [uf.ALPHABET.find(c) + 1 for c in r.url] + [uf.END]
        total += len(codes)
        for i, x in enumerate(codes):
            for k in range(min(i, uf.ORDER) + 1):
                context = own.setdefault(tuple(codes[i - k:i]), {})
                context[r.verdict, x] = context.get((r.verdict, x), 0) + 1
    assert counts == {c: n for c, n in own.items() if sum(n.values()) * uf.SHARE >= total}
    moves, gains = uf.automaton(counts)
    tried = urls[::20] + list(enumerate(ODD))
    got = {(r.page_id, r.url): r.x for r in spark.createDataFrame(tried, SCHEMA).withColumn("x", uf.score(F.col("url"), moves, gains)).collect()}
    for k, u in tried:
        assert abs(got[k, u] - slow_score(u, counts)) < 1e-4, u


def test_held_out_accuracy(spark, urls):
    """Labelled URLs that neither training nor calibration sees are judged as the rules do."""
    labelled = [(k, u) for k, u in urls if rule(*parts(u))[0]]
    seen, unseen = [r for r in labelled if r[0] % 3], [r for r in labelled if r[0] % 3 == 0]
    model = uf.train(spark.createDataFrame(seen, SCHEMA))
    x = spark.createDataFrame(unseen, SCHEMA).withColumn("x", uf.score(F.col("url"), model.moves, model.gains)).collect()
    right = {v: [(model.slope * r.x + model.offset >= 0) == (v == "allow") for r in x if rule(*parts(r.url))[1] == v] for v in ("allow", "block")}
    assert all(sum(r) / len(r) > 0.9 for r in right.values()), {v: sum(r) / len(r) for v, r in right.items()}


def test_verdict_follows_score_where_no_rule_fits(spark, urls):
    df = spark.createDataFrame(urls, SCHEMA)
    model = uf.train(df)
    out = uf.with_verdict(df, "v", model=model).select("page_id", "v.*").where("rule IS NULL").collect()
    assert {r.verdict for r in out} == {"allow", "block"}
    assert all((r.verdict == "block") == (model.slope * r.score + model.offset < 0) for r in out)
    left = uf.drop_blocked(df, model=model)
    assert left.columns == df.columns and left.count() == uf.with_verdict(df, "v", model=model).where("v.verdict = 'allow'").count()


def test_awkward_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert uf.verdict_table(empty).count() == 0 and uf.drop_blocked(empty).count() == 0
    none = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, None)], SCHEMA)
    assert [(r.page_id, r.verdict) for r in uf.verdict_table(none).collect()] == [(1, "allow"), (1, "allow"), (None, "allow")]
    one = spark.createDataFrame([(i, f"http://a.org/{i}") for i in range(50)] + [(99, "http://b.net/")], SCHEMA)
    assert {r.verdict for r in uf.verdict_table(one).collect()} == {"allow"}
    long = spark.createDataFrame([(1, "http://a.com/fr/" + "x" * 300_000), (2, "http://a.com/de/y"), (3, "http://q.net/" + "y/" * 200_000)], SCHEMA)
    assert {r.page_id: r.rule for r in uf.verdict_table(long).collect()} == {1: "com/fr/", 2: "com/de/", 3: None}
    clash = none.selectExpr("*", "'x' as v", "'y' as __rule", "'z' as rule", "'h' as host", "1 as verdict")
    assert uf.drop_blocked(clash).columns == clash.columns
    assert uf.verdict_table(clash).count() == 3


def test_every_labelled_url_is_counted_whole(spark):
    """More URLs of a verdict than the former sample had, and one longer than a piece on
    whose far end a context depends."""
    tail = "http://a.com/de/" + "x" * (3 * uf.PIECE - 16) + "Z%" * 400
    many = spark.range(30_000).select(F.col("id").alias("page_id"), F.format_string("http://a%d.org/%d", "id", "id").alias("url"))
    sample = uf._sample(many.unionByName(spark.createDataFrame([(-1, tail)], SCHEMA)), "url", uf.RULES).cache()
    assert sample.count() == 30_001 and sample.where("NOT held").count() + sample.where("held").count() == 30_001
    counts = uf._counts(sample.where("verdict = 'block'"))
    z, percent = uf.ALPHABET.find("Z") + 1, uf.ALPHABET.find("%") + 1
    assert counts[z,] == {("block", percent): 400}
    assert sum(counts[()].values()) == len(tail) + 1
    assert counts[percent, z][("block", percent)] == 399 and counts[percent,][("block", uf.END)] == 1
