"""Infilling, vector codes and url rules against plain forms of their definitions."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwright.llm import infill, queries, url_rules, vector_codes

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_infill", "op12_vector_codes", "op13_url_rules"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    columns, rows = want.columns, want.fetchall()
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(rows, key=repr)


# op11


def plain_infill(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_infill_is_the_plain_form(monkeypatch):
    rng = random.Random(5)
    for block in (infill.EVENT_BLOCK, 7):  # with blocks of 7, patterns straddle them
        monkeypatch.setattr(infill, "EVENT_BLOCK", block)
        for i in range(3000):
            text = "".join(rng.choice(["a", "Z", "P", "S", "M", "<", ">", " ", "\n", "é", "漢", "?", ".", "\0", "\U0001f600", "1", "ord"]) for _ in range(rng.randrange(40)))
            assert infill.infill(i, text) == plain_infill(i, text), text
        for text in ("", "<P>", "x<M>", "<P", "P>", "<<S>>", "a" * 100, "é" * 100):
            assert infill.infill(None, text) == plain_infill(None, text)


def test_infill_rows(spark):
    long = "word, 漢字! " * 200_000
    rows = [(1, None, "o"), (2, "", "o"), (None, "a b c", "o"), (None, "a b c", "o"), (4, long, "o"), (5, "a<P>b", "o"), (6, "one two <S three", "o"), (6, "other", "o")] + [(i, f"< text {i} <P", "o") for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, output string")
    made = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in made)) == sorted(repr((i, *plain_infill(i, t or ""))) for i, t, _ in rows)
    assert sorted((repr((r["doc_id"], r["back"])) for r in made)) == sorted(repr((i, t or "")) for i, t, _ in rows)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.limit(0)).collect() == []


# op12


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(256 * float(x))) for x in r[1]]))
    q = np.array([[int(np.floor(256 * float(x))) for x in v] for _, v, _ in kept], dtype=object).reshape(len(kept), parts, -1)
    books = [[list(q[i, p]) for i in range(min(entries, len(kept)))] for p in range(parts)]

    def assign():
        out = []
        for i in range(len(kept)):
            got = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(q[i, p], e, strict=True)) for e in books[p]]
                got.append((d.index(min(d)), min(d)))
            out.append(got)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [q[i, p] for i in range(len(kept)) if found[i][p][0] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for _, d in f) for f in found]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    return [(i, lab, "".join(f"{k:02x}" for k, _ in f), e, by_label[lab], digest) for (i, _, lab), f, e in zip(kept, found, errors, strict=True)]


def test_nearest_entry_with_ties():
    rng = np.random.default_rng(1)
    for wide in (1, 2, 4):
        entries = rng.integers(-3, 4, size=(64, wide))  # many equal entries and equal distances
        x = rng.integers(-5, 6, size=(3000, wide))
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index, best = vector_codes.KdTree(entries).nearest(x)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_codes_are_the_plain_form(spark):
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(size=(150, 32)), 2).tolist()
    rows = [(i, v, None if i % 7 == 0 else i % 3) for i, v in enumerate(vectors)]
    bad = list(vectors[3])
    rows += [(200, None, 1), (201, [None, *bad[1:]], 1), (202, [float("nan"), *bad[1:]], 1), (203, [float("inf"), *bad[1:]], 1)]
    rows += [(5, vectors[5], 2), (5, vectors[9], 2), (None, vectors[4], 1), (-4, [-1e-9] * 32, None)]  # repeats, null id, a floor below zero
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, code string")
    got = [(r["vec_id"], r["label"], r["code"], r["error"], int(r["label_error"]), r["codebooks_sha256"]) for r in vector_codes.compress(df.repartition(5)).collect()]
    assert sorted(got, key=repr) == sorted(plain_codes(rows), key=repr)
    few = df.filter("vec_id in (1, 2, 3)")
    assert sorted((r["code"] for r in vector_codes.compress(few).collect())) == sorted(c for _, _, c, *_ in plain_codes([r for r in rows if r[0] in (1, 2, 3)]))
    assert vector_codes.compress(df.limit(0)).collect() == []
    assert vector_codes.compress(df.filter("vec_id >= 200")).collect() == []


def test_codes_of_odd_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    empty = vector_codes.compress(make([(1, [], 1), (2, [], None)])).collect()
    assert {r["code"] for r in empty} == {"00" * 16} and {r["error"] for r in empty} == {0}
    for rows in ([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], [(1, [1.0] * 17, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(make(rows))


# op13


URLS = [
    None, "", "no scheme/net/", "http://", "http:///net/", "http://net/", "http://net", "http://net?a=/net/", "http://NET/x", "https://a.b.net/", "https://foonet/", "https://foo-net/",
    "http://example.net/en/1", "http://m.Example.NET/en/", "http://example.net/EN/", "http://example.net/en", "http://x.example.com/de/5?p=1", "http://x.example.com/fr/", "http://a.org/fr/9", "http://a.org/de/9#top",
    "http://org/fr/", "http://example.net:80/en/", "http://user@example.net/en/", "http://a.com/ads/1", "http://ads.a.com/x", "http://badads.a.com/x", "http://a.com/robots.txt", "http://ads.a.com/robots.txt",
    "http://a.com/popup", "http://a.com/popups", "http://a.com/popup?x", "http://mycasino24.com/", "ftp://spam-x.io", "http://a.com/x://net/en/", "http://a\nb.net/\u212a", "http://buy-pills.com/", "x://y://net/", "http://é.net/ü#://",
]


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    tail = rest[len(host) :]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^?#]*", tail).group()
    fits = []
    for r in rules:
        if r.name is not None:
            h, _, p = r.name.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((-len(r.name), r.name, r.verdict))
    own = [(-len(r.pattern), r.pattern, r.verdict) for r in rules if r.name is None and re.search(r.regex(), host + tail)]
    return host, path, min(fits)[1] if fits else None, min(fits)[2] if fits else min(own)[2] if own else "allow"


def test_urls_are_judged_as_by_all_rules(spark, monkeypatch):
    rng = random.Random(3)
    words = ["net", "example", "com", "org", "en", "fr", "ads", "popup", "casino", "a", "NET", "pills", "spam", "x1"]
    urls = URLS + ["http://" + "".join(rng.choice(words) + rng.choice([".", "/", "-", "?", "#", "_", ""]) for _ in range(rng.randrange(1, 7))) for _ in range(1500)]
    pages = spark.createDataFrame([(None if i == 3 else i // 2, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = url_rules.HOST_RULES + url_rules.METHOD_RULES + [url_rules.Rule("block", "||example.net^en^"), url_rules.Rule("allow", "|a.*/fr/"), url_rules.host_rule("allow", "net/en/"), url_rules.host_rule("block", "com/x1")]
    want = sorted(repr((None if i == 3 else i // 2, *plain_verdict(u, rules))) for i, u in enumerate(urls))
    for a_pass in (url_rules.RULES_A_PASS, 6):  # in one pass, and in several
        monkeypatch.setattr(url_rules, "RULES_A_PASS", a_pass)
        got = url_rules.judge_urls(pages, rules).collect()
        assert sorted(repr((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])) for r in got) == want
    assert url_rules.judge_urls(pages.limit(0)).collect() == []


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://example.net/en/"] * 5 + ["http://example.net/", "http://a.com/", "http://a.org/"] * 5)], "page_id long, url string")
    host, path, whole = url_rules.split_url(F.col("url"))
    filed = url_rules.rarest_tokens(pages.select(whole.alias("whole")), [*url_rules.HOST_RULES, url_rules.Rule("block", "*casino*"), url_rules.Rule("block", "||ab*cd.ef/")])
    assert filed == ["net", "en", "de", "fr", None, "ef"]
    index = url_rules.RuleIndex(url_rules.HOST_RULES, filed[:4])
    assert sorted(index.candidates("example.net/x/")) == [0] and sorted(index.candidates("example.net/en/")) == [0, 1]
    for bad in ("net", "net/a?b", "Net/", "a*b/"):
        with pytest.raises(ValueError):
            url_rules.host_rule("block", bad)
