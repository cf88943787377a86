import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from tarnworks.llm import chat, components, decontam, ngram_join, sharding, url_filter

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed):
    return [f"w{(i * 7919 + seed * 104729) % 100003}" for i in range(n)]


@pytest.fixture(scope="module")
def near(spark):
    base = words(120, 1)
    texts = [None, "", "  ", "one two", "One  two", "one two three four", " ".join(base), " ".join(base).upper(), " ".join([*base[:-3], "x", "y", "z"])]
    texts += [" ".join([*base[:i], "q", *base[i + 1 :]]) for i in range(0, 120, 6)]
    texts += [" ".join(words(90, s)) for s in range(2, 8)] + [" ".join(words(90, 3)[2:] + ["tail"])] * 2
    rows = [(100 - i if i != 4 else None, t, "extra", 7) for i, t in enumerate(texts)]
    return rows + [rows[6]], spark.createDataFrame(rows + [rows[6]], "doc_id long, text string, class string, n_shingles int")


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else r[0]))
    return out


def test_near_duplicates_equal_brute_force(spark, near):
    rows, docs = near
    got = ngram_join.ngram_jaccard_components(docs.repartition(3)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == sorted(brute_components(rows), key=repr)
    assert ngram_join.ngram_jaccard_components(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(7, i) for i in range(20)] + [(3, 3), (None, 1)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 50 for i in range(50, 91)} | {i: 0 for i in range(20)}


def test_contamination_equals_brute_force(spark):
    items = [(1, " ".join(words(30, 1))), (2, " ".join(words(13, 2))), (3, "Short item here"), (4, None), (5, "..."), (6, " ".join(words(30, 1)[5:25])), (2, " ".join(words(13, 2)))]
    a, b, far = words(30, 1), words(13, 2), words(400, 9)
    texts = [None, "", " ".join(a), " ".join(far), " ".join([*far[:50], *a[3:20], *far[50:]]), " ".join([*far, *b, *far, *b]), "a SHORT, item: here too", " ".join(a[:12]), " ".join([*a[:20], *a[8:]]), " ".join(a)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    for r in got:
        w, hit, ids = cut(r.text), set(), set()
        for item, t in items:
            v = cut(t)
            n = min(13, len(v))
            for i, j in itertools.product(range(len(v) - n + 1) if v else (), range(len(w) - n + 1)):
                if v[i : i + n] == w[j : j + n]:
                    hit |= set(range(j, j + n))
                    ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w))
    assert len(got) == len(texts)
    assert decontam.contamination(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    clean = decontam.contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert not any(r.contaminated for r in clean.collect())


def test_shards_are_even_and_gapless(spark):
    rows = [(i, "same text" if i % 3 == 0 else "t" * (i % 50), 1) for i in range(3000)] + [(None, None, 1), (1, "t", 1), (1, "t", 1)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 5).collect()
    size = [sum(r.size for r in got if r.shard == s) for s in range(5)]
    assert len(got) == len(rows) and max(size) - min(size) <= 2 * 60
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(5))
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string"), 5).count() == 0


def test_aliases_inherit_and_own_rules_win(spark):
    link = '<link href="{}" rel="canonical">'
    pages = [
        (1, "http://A.bad.net/x", ""),
        (2, "https://mirror.org/y?q=1#f", link.format("http://a.bad.net/x")),
        (3, "http://third.org/z", '<meta http-equiv="refresh" content="0; url=https://mirror.org/y?q=1">'),
        (4, "http://en.example.net/en/1", link.format("/en/2")),
        (5, "http://copy.com/a", link.format("http://en.example.net/en/2")),
        (6, None, None),
        (7, "no scheme", "<p>"),
        (8, "http://www.example.com/de/1", link.format("http://en.example.net/en/1")),
        (9, "http://x.org/fr/1", None),
        (9, "http://x.org/fr/1", None),
        (10, "http://b.net?x=/", None),
    ]
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}
    assert got == {
        1: ("a.bad.net", "/x", "net/", "block"),
        2: ("mirror.org", "/y", None, "block"),
        3: ("third.org", "/z", None, "block"),
        4: ("en.example.net", "/en/1", "example.net/en/", "allow"),
        5: ("copy.com", "/a", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("www.example.com", "/de/1", "example.com/de/", "block"),
        9: ("x.org", "/fr/1", "org/fr/", "allow"),
        10: ("b.net", "", None, "allow"),
    }
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def test_chat_tree_packs_depth_first_and_reads_back(spark, odd_texts):
    rows = []
    for c in range(12):
        turns = [("system", "shared start"), ("user", f"question {c % 3}")] + [("assistant", t) for t in odd_texts[: c % 4 + 1]] + [("us|er<[", f"<|end|>\n{c}")]
        rows += [(c, i, r, t, "clash") for i, (r, t) in enumerate(turns)]
    rows += [(None, 0, None, None, "clash")]
    nodes, chains = chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string"))
    tree = nodes.orderBy("packed_begin").collect()
    assert [n.packed_begin for n in tree] == [0, *[n.packed_end for n in tree][:-1]]
    assert [n.path for n in tree] == sorted(n.path for n in tree)
    assert sum(n.path.count("") - 1 == 16 for n in tree) == 2  # one shared first turn, and the null conversation's
    by = {}
    for c, i, r, t, _ in rows:
        by.setdefault(c, []).append((i, r or "", t or ""))
    got = {r.conv_id: r for r in chat.read_back(nodes, chains).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    spans = chat.attention(nodes, chains).where("conv_id = 0").first().intervals
    assert [s.position for s in spans] == [sum(x.packed_end - x.packed_begin for x in spans[:i]) for i in range(len(spans))]


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from tarnworks.llm import bpe, langid, quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = docs.where("length(text) BETWEEN 200 AND 2000").orderBy("doc_id").first().text
    other = docs.where("length(text) BETWEEN 200 AND 2000").orderBy(F.desc("doc_id")).first().text
    odd = [(None, text, "en", "s", 1), (None, other, "en", "s", 1), (900001, text, "en", "s", 1), (900001, other + " more", "en", "s", 1), (900002, None, None, None, None), (900003, " ", "en", "s", 0), (900004, "x" * 5000, "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()
    names = docs.columns
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    before = sorted(docs.collect(), key=key)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(names)] == names
        after = sorted(out.collect(), key=key)
        whole = sorted(map(tuple, out.select(*names).collect()), key=str)
        if name == "quality classifier":
            model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            score = model.score(quality.statistics([r.text or "" for r in before]))
            want = [r for r, s in zip(before, score, strict=True) if s >= 0.5]
        elif name == "language ID":
            langs, score = langid.fit(docs).predict([r.text or "" for r in before])
            want = [r for r, x, s in zip(before, langs, score, strict=True) if x != "und" and s >= 0.5]
        elif name == "n-gram Jaccard join":
            roots = brute_components([(i, r.text) for i, r in enumerate(before)])
            want = [r for r, (i, _, root) in zip(before, roots, strict=True) if root == i]
        elif name == "benchmark decontamination":
            hit = {r.doc_id: r.contaminated for r in decontam.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            want = [r for r in before if not hit[r.doc_id]]
        else:
            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
            want = before
            assert all(r.decodes and r.token_ids == own.encode_ordinary(r.text or "") for r in after)
        assert whole == sorted((tuple(r[c] for c in names) for r in want), key=str), name
        docs, before = spark.createDataFrame([tuple(r[c] for c in names) for r in after], docs.schema), [r for r in after]
    assert 0 < len(before) < 200
