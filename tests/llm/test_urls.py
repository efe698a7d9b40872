"""Aliases of URLs against a plain walk over edges."""

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import duckdb
import pytest

from tidemark.llm import url_filter as U

TRACKING = re.compile(r"(utm_[a-z]+|ref|fbclid|gclid)=")


def canonical(url):
    page, _, query = url.split("#", 1)[0].partition("?")
    kept = [p for p in query.split("&") if p and not TRACKING.match(p)]
    return page + ("?" + "&".join(kept) if kept else "")


CASES = ["https://a.org/p?utm_source=q&a=1", "https://a.org/p?a=1&utm_source=q", "https://a.org/p?a=1&ref=2&b=3", "https://a.org/p?x=1&ref=2&y=3#f", "https://a.org/p?&a=1", "https://a.org/p?ref=2", "https://a.org/p?", "https://a.org/p#?ref=1", "https://a.org/p?utm_medium=x&gclid=1&fbclid=2", "https://a.org/p?myref=1&reference=2", "https://a.org/p?a=1?b=2&ref=3", "x", ""]


def test_canonical(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string").select("url", U.canonical(U.F.col("url")).alias("c"))
    assert {r["url"]: r["c"] for r in df.collect()} == {u: canonical(u) for u in CASES}
    assert canonical(CASES[0]) == canonical(CASES[1]) == "https://a.org/p?a=1" and canonical(CASES[2]) == "https://a.org/p?a=1&b=3"


def pages():
    """Chains of aliases over all kinds of edges, tracking parameters first, in the middle and last."""
    link = "<html><link rel='canonical' href='{}'></html>"
    refresh = '<META name=x HTTP-EQUIV="refresh" content="3; URL={}">'
    rows = [(u, "") for u in CASES] + [("https://a.org/p?a=1", link.format("https://b.org/one")), ("https://b.org/one?gclid=9", refresh.format("https://c.net/es/x")), ("https://b.org/one", None)]
    rows += [("https://d.org/?z=1&utm_x=2", None), ("https://d.org/?z=1", link.format("https://e.org/")), ("https://e.org/", ""), ("https://f.org/p", link.format("/relative")), ("https://www.example.com/en/q", link.format("https://c.net/es/x")), (None, link.format("https://c.net/es/x")), ("https://g.org/a", link.format("https://c.net/fr/y")), ("https://g.org/a?b", None)]
    start = len(rows)
    blocked = "https://c.net/es/x"
    rows += [(f"https://s{i}.org/dir/page?q=1", h) for i, h in enumerate(DECLARATIONS)]
    rows += [("https://c.net/es/x", None), ("https://c.net/fr/y", None), ("x", link.format(blocked)), ("", link.format(blocked)), (None, None)]
    return [(i, u, h) for i, (u, h) in enumerate(rows)], start


# What declares an alias of a blocked page, and what only looks as if it did.
DECLARATIONS = [
    "<link rel=canonical href=https://c.net/es/x>",
    "<LINK HREF='https://c.net/es/x' REL='Canonical'>",
    '<link rel="nofollow canonical" href="//c.net/es/x">',
    '<meta content="0;url=https://c.net/es/x" http-equiv="refresh">',
    "<meta http-equiv=refresh content='5; URL=\"https://c.net/es/x\"'>",
    "<meta http-equiv='Refresh' content='0, https://c.net/es/x#top'>",
    '<base href="https://c.net/es/deep/"><link rel="canonical" href="../x">',
    '<base href="//c.net/fr/"><link rel="canonical" href="y">',
    "<link title='a > b' data-x=1 rel=canonical href=' https://c.net/es/x '>",
    '<link rel="canonical" href="https://c.net/es/x?utm_source=a&amp;ref=b">',
    "<script>var a = '<!-- x';</script><link rel=canonical href=https://c.net/es/x>",
    "<link rel=canonical\nhref=https://c.net/es/x>",
    "<link rel=canonical href=https://a.org/none><link rel=canonical href=https://c.net/es/x>",
    "<!-- <link rel=canonical href=https://c.net/es/x> -->",
    "<script>'<link rel=canonical href=https://c.net/es/x>'</script>",
    "<style><link rel=canonical href=https://c.net/es/x></style>",
    "<link rel=canonical data-href=https://c.net/es/x>",
    "<link rel=canonical title=\"href='https://c.net/es/x'\">",
    "<link rel=stylesheet href=https://c.net/es/x>",
    "<linkx rel=canonical href=https://c.net/es/x>",
    "<meta http-equiv=refresh content=5>",
    "<meta name=refresh content='0;url=https://c.net/es/x'>",
    "<link rel=canonical href='mailto:c.net/es/x'>",
    "<link rel=canonical href='#https://c.net/es/x'>",
    "<link rel=canonical href=''>",
    "<link rel=canonical href='/dir/./up/../page?q=1'>",
    "<link rel=canonical href='?q=2'>",
    "<link rel=canonical href='other?to=https://c.net/es/x'>",
    "<!-- open <link rel=canonical href=https://c.net/es/x>",
]
BLOCKED = 13


class Declared(HTMLParser):
    """What a browser's parser would see."""

    def __init__(self, url, html):
        super().__init__()
        self.base, self.found, self.based = url, [], False
        self.feed(html)

    def handle_starttag(self, tag, given):
        a = {}
        for k, v in given:
            a.setdefault(k, v or "")
        if tag == "base" and "href" in a and not self.based:
            self.base, self.based = urljoin(self.base, a["href"].strip()), True
        if tag == "link" and "canonical" in a.get("rel", "").lower().split() and "href" in a:
            self.found.append(a["href"])
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
            address = re.match(r"""\s*[0-9.]+\s*[;,\s]\s*(?:url\s*=)?\s*["']?([^"']*)""", a.get("content", ""), re.I)
            self.found += [address.group(1)] if address else []

    def targets(self):
        wanted = [x.strip() for x in self.found]
        wanted = [x for x in wanted if x and not x.startswith("#")]
        return [x if "://" in x.split("?")[0] else urljoin(self.base, x) for x in wanted if "://" in x.split("?")[0] or "://" in self.base]


def verdicts(rows):
    edges = []
    for _, u, h in rows:
        if u is None:
            continue
        found = [canonical(x) for x in (u, *Declared(u, h or "").targets())]
        edges += [(u, v) for v in found if v != u and "://" in v]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def rule(url):
        found = re.match(r"[^/?#]*", url.split("://", 1)[1]).group().lower() if "://" in url else ""
        path = re.match(r"[^/?#]*([^?#]*)", url.split("://", 1)[1]).group(1) if "://" in url else ""
        fits = [(h + p, v) for v, h, p in U.RULES if (found == h or found.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda x: len(x[0])) if fits else (None, None)

    out = {}
    for i, u, _ in rows:
        seen, todo = {u}, [u]
        while todo:
            for v in near.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        name, own = rule(u or "")
        out[i] = (name, own or ("block" if any(rule(v or "")[1] == "block" for v in seen) else "allow"))
    return out


def test_verdicts_follow_all_edges(spark, tmp_path):
    rows, start = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.url_filter(df, U.RULES).collect()}
    want = verdicts(rows)
    assert got == want
    assert [want[start + i][1] for i in range(len(DECLARATIONS))] == ["block" if i < BLOCKED else "allow" for i in range(len(DECLARATIONS))]
    assert {want[i][1] for i in (0, 1, 13, 14, 15)} == {"block"} and want[17][1] == "allow"
    df.coalesce(1).write.parquet(str(tmp_path / "pages"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    assert {r[0]: (r[3], r[4]) for r in db.execute(U.OP9_SQL).fetchall()} == want


def test_null_and_repeated_ids(spark):
    link = "<link rel=canonical href=https://c.net/es/x>"
    rows = [(None, "https://a.org/1", link), (None, "https://a.org/2", None), (5, "https://a.org/3", None), (5, "https://a.org/3", link), (5, "https://a.org/4", ""), (6, "https://a.org/1?ref=z", None)]
    df = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, host string, verdict string")
    got = sorted(((r["page_id"], r["verdict"]) for r in U.url_filter(df, U.RULES).collect()), key=repr)
    assert got == sorted([(None, "block"), (None, "allow"), (5, "block"), (5, "block"), (5, "allow"), (6, "block")], key=repr)
    assert U.url_filter(df.limit(0), U.RULES).collect() == []


def test_extra_edges_know_tracking(spark):
    df = spark.createDataFrame([(1, "https://a.org/p?ref=1", None)], "page_id long, url string, html string")
    extra = spark.createDataFrame([("https://a.org/p", "https://b.org/q?utm_x=1"), ("https://b.org/q", "https://c.net/fr/z")], "a string, b string")
    assert U.url_filter(df, U.RULES, extra).first()["verdict"] == "block"
