import gzip
import hashlib

from attrition.llm import warc_index as w
from tests.llm.cases import as_set

SCHEMA = "page_id long, url string, html string, payload string, digest string, file string"


def rows():
    big = "x" * 1500
    out = [(i, f"http://www.h{i % 3}.example.com/p/{i % 7}?q={i}#f", f"<p>page {i}</p>" + big * (i % 2)) for i in range(40)]
    out += [(100 + i, "http://hot.example.com/", big) for i in range(60)]  # one URL, one payload
    out += [(200, None, big), (201, "not a url", ""), (202, "http://e.com/\r\nX: y", None), (203, "HTTP://u:p@HOST.Org:81/A?b", "é" * 499 + "a"),
            (204, "http://host.org:81/A?b", "é" * 499 + "a"), (205, "http://l.org/", "z" * 400_000), (207, "u1", "é" * 500), (208, "u2", "é" * 500),
            (208, "u2", "é" * 500), (None, "http://n.org/", big), (None, None, "only <b>null</b> id " * 100)]
    return [(*r, "own", "own", "own") for r in out]


def brute(table):
    best, out = {}, []
    for k, _, h, *_ in table:
        d = (h or "").encode()
        if len(d) >= 1000 and k is not None:
            best[d] = max(k, best.get(d, k))
    for k, _, h, *_ in table:
        d = (h or "").encode()
        to = best.get(d) if len(d) >= 1000 and k != best.get(d) else None
        out.append((k, len(d), hashlib.sha1(d).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_round_trip(spark):
    table = rows()
    pages = spark.createDataFrame(table, SCHEMA)
    assert as_set(w.archive_table(pages)) == brute(table)


def test_payloads_and_single_look_ups(spark, monkeypatch):
    table = rows()
    pages = spark.createDataFrame(table, SCHEMA)
    spark_dir = w.shared_folder(spark, "t"), w.shared_folder(spark, "t")
    index = w.build_index(w.write_archives(pages, spark_dir[0]), spark_dir[0], spark_dir[1], block_entries=4)
    one = spark.createDataFrame([("http://www.h1.example.com/p/1?q=1",), ("http://missing.org/",), ("http://hot.example.com/",)], "url string")
    got = w.fetch(index, w.look_up(index, one)).collect()
    assert sorted(r.page_id for r in got) == [1, *range(100, 160)]
    assert next(bytes(r.payload).decode() for r in got if r.page_id == 1) == table[1][2]
    assert len(index.files) >= 1 and [f.first for f in index.files] == sorted(f.first for f in index.files)


def test_archives_are_readable_by_any_gzip_reader(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>hé</p>")], "page_id long, url string, html string")
    folder = w.shared_folder(spark, "t")
    captures = w.write_archives(pages, folder).collect()
    fs, base = w.open_fs(folder)
    with fs.open_input_stream(f"{base}/{captures[0].file}", compression=None) as f:
        raw = gzip.decompress(f.read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith("<p>hé</p>\r\n\r\n".encode())


def test_surt(spark):
    urls = ["http://www.Example.com/a/B?q#f", "https://u:p@h.org:8080", "mailto:x", None, "", "http://h.org?x=http://y.z/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(w.surt(w.F.col("url")).alias("s"))
    assert [r.s for r in df.collect()] == ["com,example,www)/a/B?q", "org,h):8080", ")mailto:x", "", ")", "org,h)?x=http://y.z/"]


def test_empty(spark):
    assert w.archive_table(spark.createDataFrame([], SCHEMA)).collect() == []


def test_records_are_read_back_by_several_tasks(spark):
    """However few bytes the pointers have, the records' own bytes set the number of tasks."""
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example/{i}", "x" * 300 + str(i)) for i in range(400)], "page_id long, url string, html string")
    index = w.archive(pages)
    captures = w.look_up(index, pages)
    total = captures.agg({"length": "sum"}).first()[0]
    got = w.fetch(index, captures, fetch_bytes=total // 6)
    assert got.count() == 400 and got.rdd.getNumPartitions() >= 6
