import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb

from attrition.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
SF = "/root/testdata/sf0.01"


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            x = ""
        if kind == 2:
            x = re.sub("[.!?]", "", x)
        if kind == 4:
            r = "user"
        out += [(c, t, r, x)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by plain recursion over whole edit strings."""
    seen, marks = set(), []
    for _, _, r, x in rows:
        bare = x.strip(SPACE)
        marks.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))

    @lru_cache(None)
    def best(i, roles, inserted):
        """roles: the last two initials given and whether any was (enough to know what may follow)."""
        options = []
        if i == len(rows):
            if roles == "" or roles[-1] == "a":
                options.append((0, "", ()))
        else:
            _, _, r, x = rows[i]
            gone = marks[i] in ("blank", "duplicate")
            cost, audit, kept = best(i + 1, roles, 0)
            options.append((4 + cost, "D" + audit, kept))
            if not gone:
                for letter, new, own in (("K", r, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if allowed(roles, new[:1]):
                        cost, audit, kept = best(i + 1, new[:1], 0)
                        options.append((own + 3 * (marks[i] == "truncated") + cost, letter + audit, ((new, x), *kept)))
        if inserted < 2:
            for new in ("user", "assistant"):
                if allowed(roles, new[0]):
                    cost, audit, kept = best(i, new[0], inserted + 1)
                    options.append((3 + cost, "I" + audit, ((new, ""), *kept)))
        return min(options, default=(10 ** 9, "", ()))

    def allowed(before, initial):
        return initial != "" and {"": "su", "s": "u", "u": "a", "a": "u"}[before].find(initial) >= 0

    cost, audit, kept = best(0, "", 0)
    wrong = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{x}" for r, x in kept)
    return (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), wrong, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def brute(rows, hurt=damage):
    after = {}
    for row in hurt(rows):
        after.setdefault(row[0], []).append(row)
    def place(row):
        return (row[1] is not None, row[1] or 0, row[2], hashlib.sha256(row[3].encode()).digest())
    return sorted(((c, *cheapest(sorted(after.get(c, []), key=place))) for c in {r[0] for r in rows}), key=repr)


def rows_for(rng, conversations):
    out = []
    for c in range(conversations):
        for t in range(rng.randrange(0, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "what", " ", "", None, "long one?  \n", "x" * 50 + ".", " ", "a. b", "…"])
            out.append((rng.choice([c, c, c, None]) if c % 7 == 0 else c, rng.choice([t, t, t, t, None]) if c % 5 == 0 else t, role, text))
    return out


def got(df):
    return sorted(map(tuple, cr.repair_table(df).collect()), key=repr)


def test_query_matches_brute_force(spark):
    rng = random.Random(5)
    rows = rows_for(rng, 150)
    rows += rows[:40] + [rows[3]] * 9  # repeated rows
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT * FROM '{SF}/conversations.parquet'").fetchall()
    assert got(spark.read.parquet(f"{SF}/conversations.parquet")) == brute(rows)


def test_long_conversation_over_many_blocks_and_partitions(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"line {t % 211}.", f"cut {t % 97}", "", "same."])) for t in range(700)]
    rows += [(2, 5, "user", "copies.")] * 300 + [(3, None, "user", "Hm."), (3, None, "assistant", "Ja.")]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows_out, summary = cr.repair(df)
        found = {r.conv_id: r for r in summary.collect()}
        kept = {c: [] for c in (1, 2, 3)}
        for r in rows_out.orderBy("conv_id", "place").collect():
            kept[r.conv_id].append(r)
        digests = dict(map(tuple, cr.row_digests(rows_out).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    import sys
    sys.setrecursionlimit(20000)
    for c, *want in brute(rows, list):
        assert [*found[c][1:], digests[c]] == want, c
        assert "".join(r.edit for r in kept[c]) == found[c].audit
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept[1] if r.edit != "D"))


def test_blocks_and_whole_agree():
    """Matrices combined over blocks of any size give the vectors of one pass."""
    rng = random.Random(1)
    for _ in range(200):
        units = [(rng.choice("suat "), rng.choice([0, 0, 1, 2]), rng.choice([1, 1, 2])) for _ in range(rng.randrange(1, 14))]
        whole = list(cr.FINISH)
        for u in reversed(units):
            whole = cr.back(whole, u)
        edits, state = cr.forward(units, list(cr.FINISH), 0)
        letters = [len(ins) * 3 + {"K": 0, "R": 3, "D": 4}[e] + 4 * (u[2] - 1) + 3 * (u[1] == 1 and e != "D") for (ins, e, _), u in zip(edits, units)]
        assert sum(letters) + cr.FINISH[state] == whole[0]


def test_empty_and_extra_columns(spark):
    assert cr.repair_table(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (None, None, None, None)]
    plain = spark.createDataFrame(rows, SCHEMA)
    more = plain.selectExpr("*", "'own' as c", "'own' as at", "1 as kind", "2 as units", "'x' as place", "'y' as audit")
    assert got(more) == got(plain) == brute(rows)
    assert cr.repair(plain).rows.columns == ["conv_id", "place", "edit", "turn", "role", "text"]
