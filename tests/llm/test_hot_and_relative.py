"""Conversations and pages beyond what the given tables hold."""

import hashlib
import random

from pyspark.sql import functions as F

from tarnworks.llm import chat, url_filter


def test_chat_tree_of_long_conversations_keeps_keys_short(spark):
    rng = random.Random(2)
    long = [(7, i, "user", f"t{i}") for i in range(3000)]
    branch = [(c, i, "user", f"t{i}" if i < 2990 - c else f"{c}") for c in (3, 9) for i in range(2995 - c)]
    small = [(c if c != 120 else None, i, rng.choice(["user", "assistant"]), rng.choice("ab[<")) for c in range(100, 160) for i in range(rng.randrange(1, 7))]
    rows = long + branch + small
    rng.shuffle(rows)
    nodes, chains = chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    tree = nodes.orderBy("packed_begin").collect()
    assert max(len(n.path) for n in tree) <= 24
    assert [n.path for n in tree] == sorted({n.path for n in tree})
    assert [n.packed_begin for n in tree] == [0, *[n.packed_end for n in tree][:-1]]
    parent, ways = {}, {}
    for r in chains.collect():
        ways.setdefault(r.conv_id, {})[r.nth] = r.node
    for way in ways.values():
        for nth, node in way.items():
            assert parent.setdefault(node, way.get(nth - 1)) == way.get(nth - 1)
    stack = []
    for n in tree:  # depth first: the parent is on the way to the node before
        while stack and stack[-1] != parent[n.node]:
            stack.pop()
        assert stack or parent[n.node] is None
        stack.append(n.node)
    assert len(parent) == len(tree)
    by = {}
    for c, i, r, t in sorted(rows, key=lambda x: (x[0] or 0, *x[1:])):
        by.setdefault(c, []).append((r, t))
    got = {r.conv_id: r for r in chat.read_back(nodes, chains).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_sha256) == (len(turns), hashlib.sha256(loss.encode()).hexdigest())


def test_relative_aliases_are_resolved(spark):
    from urllib.parse import urljoin

    page = "http://a.org/d/e/f.html?q=1"
    links = ["next.html", "?p=2", "../x", "../../../y", "./", "..", ".", "g/./h/../i", "/r/../s", "//b.org/t", "https://c.org/u?v=1", "z?u=http://d.org/", "#top"]
    df = spark.createDataFrame([(i, x, "a.org", "/d/e/f.html", "?q=1") for i, x in enumerate(links)], "n int, link string, host string, path string, query string")
    got = {r.n: r.to for r in df.select("n", url_filter.resolve(*(F.col(c) for c in ("link", "host", "path", "query"))).alias("to")).collect()}
    assert got == {i: urljoin(page, x).split("#")[0] for i, x in enumerate(links)}

    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    pages = [
        (1, "http://m.org/a/go", refresh.format("stop.html")), (2, "http://m.org/a/stop.html", '<link rel="canonical" href="http://bad.net/1">'),
        (3, "http://m.org/b?i=1", refresh.format("?i=2&amp;j=3")), (4, "http://m.org/b?i=2&j=3", '<link rel="canonical" href="http://bad.net/2">'),
        (5, "http://m.org/c/d/e", '<base href="http://bad.net/k/">' + refresh.format("l")), (6, "http://m.org/c/d/f", refresh.format("../g")),
        (7, "http://m.org/c/g", '<link rel="canonical" href="http://bad.net/3">'), (8, "http://m.org/h", refresh.format("mailto:x@bad.net")), (9, "http://m.org/free", refresh.format("free2")),
    ]
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert [i for i in range(1, 10) if got[i] == "block"] == [1, 2, 3, 4, 5, 6, 7] and len(got) == 9


def test_allow_wins_between_rules_of_one_host_and_path(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", None)], "page_id long, url string, html string")
    rules = spark.createDataFrame([("example", "/x", "allow"), ("example", "/x", "block")], "host string, path string, verdict string")
    assert [r.verdict for r in url_filter.judge_urls(pages, rules).collect()] == ["allow"]
