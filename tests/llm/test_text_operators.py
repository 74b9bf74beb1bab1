"""Decontamination, line dedup, license scans, URL filters."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chartlake.llm import decontam, license_scan, line_dedup, url_filter

from .conftest import prose


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute_leaks(doc, items):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        t = words(text)
        n = min(13, len(t))
        for i in range(len(t) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == t[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item) if item is not None else "")
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [10**6, 200])
def test_leaks_equal_brute_force(spark, make_docs, block_bytes):
    items = [(1, prose(50, 30)), (2, "w1 w2"), (3, "w5"), (4, None), (5, "..."), (1, prose(51, 13)), (None, prose(52, 14)), (10, prose(53, 12))]
    rows = [(1, None, "s"), (2, "", "s"), (3, prose(50, 30).upper(), "s"), (4, "x " + prose(51, 13) + " y", "s"), (4, "x " + prose(51, 13) + " y", "s"), (5, prose(50, 12), "s"), (6, prose(53, 12).replace(" ", "--"), "s"), (7, prose(52, 14) + " z " + prose(50, 20), "s")]
    rows += [(10 + i, prose(60 + i, 200, 12), "s") for i in range(8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.judged(decontam.find_leaks(make_docs(rows), bench, block_bytes=block_bytes)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == sorted((i, *brute_leaks(t, items)) for i, t, _ in rows)
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)


def test_leaks_awkward(spark, awkward, make_docs):
    bench = spark.createDataFrame([(1, prose(1, 120))], "item_id long, text string")
    none = bench.where("false")
    for block_bytes in (10**6, 100):
        some = make_docs([(None, prose(1, 120), "s"), (None, "clean text without id", "s"), (3, prose(1, 120), "s"), (3, "clean text of the same id", "s"), (4, None, "s")])
        left = decontam.drop_contaminated(some, bench.unionByName(spark.createDataFrame([(2, prose(9, 30)), (3, prose(10, 30))], bench.schema)), block_bytes=block_bytes)
        assert sorted((r["doc_id"] or 0, r["text"]) for r in left.where("text is not null").collect()) == [(0, "clean text without id"), (3, "clean text of the same id")] and left.count() == 3
    assert decontam.find_leaks(awkward, bench).count() == awkward.count()
    kept = decontam.drop_contaminated(awkward, bench)
    assert {4, 5, 6, 7, 15}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.columns == awkward.columns
    assert decontam.drop_contaminated(awkward, none).count() == awkward.count()
    assert decontam.find_leaks(make_docs([]), bench).collect() == []


def test_wu_manber_jumps():
    m = decontam.WuManber(4, [b"a", b"b", b"c", b"d", b"e"], {0: "x", 1: "y"})
    text = [b"q"] * 50 + [b"a", b"b", b"c", b"d", b"e"] + [b"q"] * 50
    assert list(m.find(text)) == [(50, 0), (51, 1)]
    assert m.jump == 3 and m.shift[b"c", b"d"] == 0


def brute_lines(rows):
    """First places win by (id, hash of the text, line); later places go. rows: (id, text, hash of the text)."""
    seen, gone = {}, {}
    for i, text, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        if text is None:
            continue
        lines = [x.strip(" \t\n\r\x0b\x0c") for x in text.split("\n")]
        for at in range(max(1, len(lines) - 2)):
            w = tuple(lines[at : at + 3])
            if not any(w):
                continue
            if seen.setdefault(w, (i, h, at)) != (i, h, at):
                gone.setdefault((i, h), set()).update(range(at, at + 3))
    out = []
    for i, text, h in rows:
        lines = (text or "").split("\n")
        out.append((i, None if text is None else "\n".join(x for n, x in enumerate(lines) if n not in gone.get((i, h), ()))))
    return out


def hashed(df):
    return [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]


def key(r):
    return (r[0] is None, r[0] or 0, r[1] or "")


def test_lines_equal_brute_force(make_docs, awkward):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcdef ") * rng.randrange(0, 3) for _ in range(rng.randrange(0, 12))), "s") for i in range(120)]
    rows += [(200, " a \nb\nc", "s"), (201, "a\nb\nc\r\nnew", "s"), (202, "\n\n\n\n", "s"), (203, "same\n" * 6, "s")]
    # texts without id, of equal ids and exact repeated rows
    shared = [(None, "a b c x1".replace(" ", "\n"), "s"), (None, "p\nq\nr\ns", "s"), (None, "zz\na\nb\nc", "s"), (9, "k\nl\nm\nn", "s"), (9, "u\nv\nw\nt", "s"), (7, "k\nl\nm", "s"), (7, "k\nl\nm", "s"), (9, "u\nv\nw\nt", "s"), (11, "u\nv\nw", "s")]
    texts = [r["text"] for r in line_dedup.dedup_lines(make_docs(shared)).collect()]
    assert {"p\nq\nr\ns", "u\nv\nw\nt", "n"} <= set(texts) and texts.count("k\nl\nm") == 2
    for df in (make_docs(rows), awkward, make_docs(shared)):
        got = line_dedup.dedup_lines(df)
        want = brute_lines(hashed(df))
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(want, key=key)
        assert set(df.columns) <= set(got.columns)


def test_lines_drop_emptied(make_docs):
    df = make_docs([(1, "a\nb\nc", "s"), (2, "a\nb\nc", "s"), (3, "", "s"), (4, None, "s"), (5, "a\nb\nc\nd", "s")])
    out = line_dedup.dedup_lines(df, drop_emptied=True, counts=False)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"]) == [(1, "a\nb\nc"), (5, "d")]
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5] and out.columns == df.columns
    assert line_dedup.dedup_lines(make_docs([])).collect() == []


def license_words(text):
    return re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_licenses(text):
    w, out = license_words(text), []
    for name, body in sorted(license_scan.TEMPLATES.items()):
        t = license_words(body)
        n = min(5, len(t))
        own = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
        share = len(own & {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) / len(own)
        if share >= 0.75:
            out.append((name, share))
    return out


def test_licenses(make_docs, awkward):
    rows, rng = [], random.Random(8)
    for name, body in license_scan.TEMPLATES.items():
        for shift in range(9):
            t = license_words(body)
            if shift > 5 and len(t) > 12:
                t[rng.randrange(2, len(t) - 2)] = "otherwise"
            rows.append((len(rows), prose(shift, shift * 7) + " " + "  ".join(t) + ". " + prose(70, 30), name))
    rows += [(1000, "\n".join(license_scan.TEMPLATES.values()), "all"), (1001, "permission is granted", "none")]
    for df in (make_docs(rows), awkward):
        got = {(r["doc_id"], r["text"]): [(m["name"], m["containment"]) for m in r["licenses"]] for r in license_scan.scan_licenses(df).collect()}
        for (i, text), found in got.items():
            assert found == brute_licenses(text), (i, text and text[:80])
    assert license_scan.scan_licenses(make_docs([])).collect() == []
    assert [r["licenses"] for r in license_scan.scan_licenses(make_docs([(1, "all rights reserved", "s")]), templates={}).collect()] == [[]]


def test_license_windows():
    assert [license_scan.scale_of(n) for n in (1, 2, 4, 5, 10, 11, 22, 23)] == [0, 1, 1, 2, 2, 3, 3, 4]


def brute_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), f"{h}{p}", v) for h, p, v in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[1:]
    spam = any(t in url_filter.SPAM_WORDS for t in re.split("[^a-z0-9]+", host))
    return host, path, None, "block" if spam else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme/org/", "http://org", "http://org/", "HTTP://WWW.Example.ORG/es/1?x", "http://example.org/en/1", "http://example.org/en/12#a", "http://example.org/EN/1", "http://notexample.org/es/", "http://a.com/fr/x", "http://a.com/de/", "http://com/de/x?u=http://b.org/",
            "http://casino-win.example.net/", "http://casinos.net/", "http://x.ads", "http://a.com", "ftp://a b.org/x", "http://evil.com/fr\n/", "://org/a", "http://É.org/", "http://a.net/?q=org/", "http://org:80/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls)], "page_id long, url string, host string")
    got = url_filter.filter_urls(df).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_url(r["url"]), r["url"]
    assert url_filter.filter_urls(df.where("false")).collect() == []


def test_url_index_uses_rarest_token():
    rule = url_filter.host_rule("example.org", "/es/", "block")
    index = url_filter.build_index([rule, url_filter.Rule("any", ".", "allow", (), 1)], {"example": 9, "org": 5, "es": 2})
    assert set(index) == {"es", ""}


def test_only_fetched_rules_run(spark):
    """Of five thousand rules from a table, a URL compiles and runs those under its own tokens only."""
    table = spark.createDataFrame([(f"site{i}.example", f"/p{i % 7}/", "block" if i % 2 else "allow") for i in range(5000)] + [(None, "/", "block"), ("one.org", None, "block")], "host string, path string, verdict string")
    rules = url_filter.rules_of(table)
    index, compiled = url_filter.build_index(rules, {"example": 10**6}), {}
    assert len(rules) == 5001
    best = url_filter.judge(index, compiled, "www.site41.example", "/p6/x")
    assert (best.name, best.verdict) == ("site41.example/p6/", "block") and len(compiled) == 1
    assert url_filter.judge(index, compiled, "unknown.example", "/p6/") is None and len(compiled) < 3
    urls = spark.createDataFrame([(1, "http://site41.example/p6/"), (2, "http://a.site40.example/p5/1"), (3, "http://site41.example/p5/"), (4, "http://one.org")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(urls, rules=rules).collect()}
    assert got == {1: ("site41.example/p6/", "block"), 2: ("site40.example/p5/", "allow"), 3: (None, "allow"), 4: (None, "allow")}


def test_license_recall_on_scattered_edits(make_docs):
    """Every template of some length with edits all over it: what exact containment finds, the bands retrieve."""
    rng, rows = random.Random(12), []
    for name, body in license_scan.TEMPLATES.items():
        t = license_words(body)
        if len(t) < 20:
            continue
        for share in (0.0, 0.01, 0.02, 0.03, 0.04):
            for _ in range(6):
                words_ = [f"x{rng.randrange(99)}" if rng.random() < share else w for w in t]
                rows.append((len(rows), prose(len(rows), 40) + " " + " ".join(words_) + " " + prose(len(rows) + 1, 40), name))
    want = {(i, name) for i, text, _ in rows for name, _ in brute_licenses(text)}
    got = {(r["doc_id"], m["name"]) for r in license_scan.scan_licenses(make_docs(rows)).collect() for m in r["licenses"]}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 150
