"""Brute-force checks of the operators on built-in functions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hubspark.llm import decontam, license_scan, quality_rules, sharding, url_filter
from hubspark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, 7, 7) for i, t in enumerate(texts)], DOCS)


def corpus(spark, sf_dir):
    return [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


ODD = [None, "", " \t\n", "x", "a b c d e f g h " * 30, "\n\n".join(["same line here"] * 4), "É ÀB Éé straße\x0bx\x1cy z", "w" * 5000, "# | < > $ % &* x"]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2100)] + [(5, 5), (None, 3), (4, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


JUMPS = [(1, 1, 0), (42, 57, 43), (0xDEAD10CC, 1, 0), (0xDEAD10CC, 666, 361), (256, 1024, 520)]  # published values


@pytest.mark.parametrize(("key", "n", "shard"), JUMPS)
def test_jump_hash(spark, key, n, shard):
    assert spark.createDataFrame([(key,)], "k long").select(sharding.jump_hash("k", n).alias("x")).first()[0]["shard"] == shard


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, sf_dir):
    texts = ODD + corpus(spark, sf_dir)
    docs = docs_of(spark, texts)
    docs = docs.union(docs.limit(20)).union(spark.createDataFrame([(None, "n", None, None, None, 1, 1), (-9, "m", None, None, None, 1, 1)], DOCS))
    for n in (1, 16):
        rows = sharding.shard_documents(docs, n).collect()
        assert len(rows) == docs.count()
        by = {}
        for r in rows:
            text = b"" if r["doc_id"] is None or r["doc_id"] < 0 else (texts[r["doc_id"]] or "").encode()
            if r["doc_id"] is None:
                assert (r["shard"], r["grown_shard"]) == (0, 0)
            else:
                assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], n), jump(r["doc_id"], n + 1))
                assert r["grown_shard"] in (r["shard"], n)
            if text or (r["doc_id"] or 0) >= 0 and r["doc_id"] is not None:
                assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
            by.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    few = sharding.slots(docs.select("doc_id").withColumnRenamed("doc_id", "d").selectExpr("d", "0 as shard"), "shard", "d", 50).collect()
    assert sorted(r["slot"] for r in few) == list(range(len(few)))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_urls(spark):
    page = lambda i, url, html="": (i, url, html, "x", "y")
    rows = [
        page(1, None), page(2, ""), page(3, "no-scheme/x"), page(4, "http://A.example.NET/en/1"), page(5, "http://example.net/de/"), page(6, "https://x.example.com/de/q?a#b"),
        page(7, "http://badexample.com/de/"), page(8, "http://foo.org/fr/x"), page(9, "http://foo.org?fr/"), page(10, "http://net"), page(11, "http://plain.com/a"),
        page(12, "http://plain.com/b", '<LINK href="http://evil.net/z" rel="canonical">'), page(13, "http://evil.net/z"), page(14, "https://www.plain.com/b/?utm_source=q#x"),
        page(15, "http://good.com/", '<meta http-equiv="refresh" content="0; url=http://w.org/fr/1">'), page(16, "http://w.org/fr/1", "<link rel=canonical href=http://evil.net/y>"), page(17, "http://evil.net/y"),
        page(18, "http://good.com"), page(18, "http://good.com"),
    ]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == len(rows)
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[5][2:] == ("net/", "block")
    assert got[6] == ("x.example.com", "/de/q", "example.com/de/", "block")
    assert got[7][2:] == got[9][2:] == (None, "allow")
    assert got[8][2:] == ("org/fr/", "allow")
    assert got[10][1:] == ("", None, "allow")  # the path is empty, so it does not start with /
    assert got[11][3] == "allow"
    assert got[12][2:] == got[14][2:] == (None, "block")
    assert got[15][2:] == got[18][2:] == (None, "allow")
    assert got[17][2:] == ("net/", "block")  # its own rule goes before the class
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_links_to_addresses_that_are_no_pages(spark):
    page = lambda i, url, html="": (i, url, html)
    meta = '<meta http-equiv="refresh" content="0;url={}">'
    rows = [
        page(1, "http://plain.com/1", "<link rel=canonical href='http://evil.net/z'>"), page(2, "http://plain.com/2", meta.format("'http://evil.net/y'")),
        page(3, "http://plain.com/3", "<link rel='canonical' href='//evil.net/x'>"), page(4, "http://example.com/a", "<link rel=canonical href='/de/y'>"),
        page(5, "http://example.com/de2/b", meta.format("../de/y2?q#f")), page(6, "http://plain.com/6", "<link rel=canonical href='mailto:x@evil.net'>"),
        page(7, "http://plain.com/7", meta.format("?p=2")), page(8, "http://plain.com/8", "<link rel=canonical href='http://w.org/fr/q'>" + meta.format("http://evil.net/8")),
        page(9, "http://www.plain.com/1/"), page(10, "http://other.com/10", meta.format("http://plain.com/2")),
    ]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    block = ("block", "alias")
    assert {r["page_id"]: (r["verdict"], r["by"]) for r in out} == {
        1: block, 2: block, 3: block, 4: block, 5: block, 6: ("allow", "default"), 7: ("allow", "default"), 8: ("allow", "alias"), 9: block, 10: block,
    }


def page_classes(rows):
    """(page_id, host, path, rule, verdict, by) by union-find over whole, host-relative and path-relative links."""
    from urllib.parse import urljoin

    def split(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        query = rest.split("#", 1)[0].partition("?")[2]
        kept = "&".join(x for x in query.split("&") if not re.match(r"(utm_[a-z]+|ref|fbclid|gclid)=", x, re.IGNORECASE)).strip("&")
        host = "".join(c.lower() if c.isascii() else c for c in host)
        return host, path, re.sub(r"^www\.", "", host) + path.rstrip("/") + (f"?{kept}" if kept else "")

    def ruled(host, path):
        fits = [(what, h + p) for what, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda r: len(r[1])) if fits else (None, None)

    parent, own = {}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    members = []
    for _, url, html in rows:
        host, path, key = split(url)
        if key is None:
            continue
        members.append((key, ruled(host, path)[0]))
        for to in re.findall(r"(?:href=|url=)'?([^'\">]+)", html or ""):
            h, p, other = split(urljoin(url, to))
            members.append((other, ruled(h, p)[0]))
            parent[find(other)] = find(key)
    for key, verdict in members:
        own.setdefault(find(key), set()).add(verdict)
    for i, url, _ in rows:
        host, path, key = split(url)
        verdict, rule = ruled(host, path)
        said = own.get(find(key), set()) - {None} if key is not None else set()
        by = "rule" if verdict else "alias" if said else "default"
        yield i, host, path, rule, verdict or ("block" if said == {"block"} else "allow"), by


def test_linked_pages_in_spark_sql_and_by_union_find(spark):
    import duckdb
    import pandas as pd

    rnd = random.Random(9)
    hosts = ["plain.com", "www.plain.com", "a.org", "evil.net", "example.com", "x.example.net", "other.io", "third.io"]
    address = lambda: f"http://{rnd.choice(hosts)}/{rnd.choice(['de', 'en', 'fr', 'x'])}/{rnd.randrange(40)}{rnd.choice(['', '/', '?p=1', '?pref=2', '?ref=2', '?a=1&utm_source=x', '#f'])}"
    to = lambda: rnd.choice([address(), address(), f"/fr/{rnd.randrange(9)}", f"//evil.net/{rnd.randrange(9)}", f"y{rnd.randrange(9)}", "?q=3"])
    rows = []
    for i in range(400):
        tags = [f"<link rel='canonical' href='{to()}'>", f'<meta http-equiv="refresh" content="0; url={to()}">', f"<link rel='stylesheet' data='{to()}'>"]
        rows.append((i, address(), "".join(rnd.choice(tags) for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])))))
    rows += [(400, None, "x"), (401, "no scheme", tags[0]), (402, "http://long.io/" + "a" * 20_000, None), (402, "http://long.io/" + "a" * 20_000, None)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = sorted(tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict", "by")) for r in out)
    assert got == sorted(page_classes(rows))
    assert {r["by"] for r in out} == {"rule", "alias", "default"}
    with duckdb.connect() as db:
        db.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
        answer = db.execute(url_filter.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, out), key=str) == sorted(answer, key=str)


def wrapped(text, width, before=""):
    import textwrap

    return "\n".join(before + line for line in textwrap.wrap(text, width))


def test_licenses(spark):
    import duckdb
    import pandas as pd

    full = {n: t for n, t in license_scan.KNOWN if len(license_scan.canonical_text(t)) >= license_scan.LONG}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "Zlib", "MPL-2.0", "GPL-3.0-or-later"} <= set(full)
    texts = [None, "", "nothing here", "Some prose.\n  RELEASED under the MIT Licence!\nmore", "Released under the MIT License. Not quite", "released under the mit license\n" * 3, "The MIT License"]
    want = {(3, "MIT", "line", 1), (5, "MIT", "line", 3)}
    for name, text in full.items():
        files = [wrapped(text, 72), wrapped(text, 50), f"The MIT License (MIT)\n\nCopyright (c) 2001-2004 Somebody\nAll rights reserved.\n\n{wrapped(text, 60)}\n", wrapped("Copyright 2001 A. Body\n", 70) + "\n" + wrapped(text.upper().replace(" ", "  "), 65, " * ")]
        want |= {(len(texts) + k, name, "text", 1) for k in range(len(files))}
        texts += files
        want |= {(len(texts), name, "part", 2)}
        texts.append("Some words before.\n" + wrapped(text, 44, "// ") + "\n\n" + wrapped(text, 80) + "\nand words after " * 3000)
        texts.append(wrapped(text, 70)[:-9] + "x")  # not quite
    mit = full["MIT"]
    want |= {(len(texts), "MIT", "text", 1), (len(texts), "MIT", "line", 1)}
    texts.append(mit)
    docs = docs_of(spark, texts)
    got = [tuple(r) for r in license_scan.scan_licenses(docs).collect()]
    assert len(got) == len(set(got))
    # a text that holds a shorter known one as its own words has that one as a part too
    inner = {x for x in got if x[2] != "line" and any(x[0] == w[0] and license_scan.canonical_text(full[x[1]]) in license_scan.canonical_text(full[w[1]]) and x[1] != w[1] for w in want if w[1] in full)}
    one_line = {x for x in got if x[2] == "line" and x[1] in full}
    assert set(got) - inner - one_line == want - one_line
    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"]))
        assert sorted(got) == sorted(db.execute(license_scan.ORACLE_SQL).fetchall())
    twice = [tuple(r) for r in license_scan.scan_licenses(docs.union(docs)).collect()]
    assert sorted(twice) == sorted((d, n, s, 2 * k) for d, n, s, k in got)
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="HINT"):
        license_scan.known_digests(spark, [("X", "do what you like")])
    same = license_scan.scan_licenses(docs_of(spark, ["Free licence for all."]), [("B", "free license for all"), ("A", "Free License, for all")]).collect()
    assert {(r["license"], r["scope"]) for r in same} == {("A", "text"), ("A", "line")}


def test_canonical_forms_of_both_kinds(spark):
    rows = spark.createDataFrame([(t,) for _, t in license_scan.KNOWN], "t string").select("t", license_scan.canonical(license_scan.F.col("t")).alias("c")).collect()
    assert all(license_scan.canonical_text(r["t"]) == r["c"] for r in rows)


def base_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, sf_dir):
    texts = ODD + corpus(spark, sf_dir)
    docs = docs_of(spark, texts)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr(f"doc_id + {len(ODD)} as doc_id", "quality", "toxic")
    rows = quality_rules.judge(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = base_of(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == b
        assert r["base_failed"] == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {r["doc_id"]: r["kept"] for r in rows if not r["base_failed"]}
    good = [kept[d] for d, q in quality.items() if q == 1 and d in kept]
    bad = [kept[d] for d, q in quality.items() if q == 0 and d in kept]
    assert sum(good) > 0.97 * len(good)
    assert sum(bad) < 0.3 * len(bad)
    assert quality_rules.judge(docs.limit(0), labels).count() == 0
    none = quality_rules.judge(docs, labels.limit(0))
    assert none.where("kept = base_failed").count() == 0
    twice = docs.union(docs)
    assert quality_rules.keep(twice, labels).count() == 2 * sum(r["kept"] for r in rows)


def test_rules_learned():
    rows = [{"bad": i % 4 == 0, "part": i % 3, "a": (10.0 if i % 4 == 0 else 1.0) + i % 7 / 10, "b": 1.0} for i in range(200)]
    (rule,) = quality_rules.learn(rows, ("a", "b"))
    assert rule.good == 0
    assert rule.bad == 50
    assert quality_rules.learn([], ("a",)) == quality_rules.learn([r | {"bad": False} for r in rows], ("a",)) == []


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def leaks(texts, items):
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    for t in texts:
        w, hit, ids = words_of(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        yield len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, sf_dir):
    rnd = random.Random(5)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "..."), (903, "x"), (904, "One two, three four."), (905, items[0][1]), (906, "a a a a a a a a a a a"), (None, items[1][1])]
    small = ["ab"[rnd.random() < 0.5] for _ in range(400)]
    texts = [*ODD, " ".join(small), "x one TWO three. four", "a " * 40, items[3][1] + " " + items[3][1], "É" + items[2][1], *corpus(spark, sf_dir)]
    items.append((907, " ".join(small[50:70])))
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    docs = docs.union(docs.where("doc_id < 30"))
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontam.decontaminate(docs, table).collect()}
    want = dict(enumerate(leaks(texts, [x for x in items if x[0] is not None])))
    assert sum(w[4] for w in want.values()) > 8
    assert got == want
    clean = {r["doc_id"] for r in decontam.clean_documents(docs, table).collect()}
    assert clean == {d for d, w in want.items() if not w[4]}
    assert decontam.decontaminate(docs, table.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(docs.limit(0), table).count() == 0
