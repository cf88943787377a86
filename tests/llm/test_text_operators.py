import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tarnworks.llm import bpe, langid, media, quality, token_counts

DOCS = "doc_id long, text string, lang string, n_tokens string, feature string"


def frame(spark, texts):
    rows = [(i % 7 if i != 3 else None, t, None if i % 5 == 0 else "en", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def tik():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_tiktoken_and_decodes(spark, odd_texts, tik):
    path, own = tik
    got = bpe.encode(frame(spark, odd_texts), path, public_tokenizers.PATTERN).collect()
    assert sorted((r.text or "", r.token_ids) for r in got) == sorted((t or "", own.encode_ordinary(t or "")) for t in odd_texts)
    assert all(bytes(r.decoded_bytes).decode() == (r.text or "") for r in got)


def test_bpe_of_random_texts(tik):
    path, own = tik
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab \n'sé1!="), rng.integers(0, 60))) for _ in range(2000)]
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    assert [x.tolist() for x in codec.encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_bpe_of_long_words_and_texts(tik):
    path, own = tik
    rng = np.random.default_rng(9)
    letters = lambda n, of: "".join(rng.choice(list(of), n))
    texts = [
        letters(100_000, "abcdefghijklmnopqrstuvwxyz"), "a" * 100_000, "ab" * 30_001, letters(5000, "ab"), "日本" * 3000, "!?" * 5000, "=" * 70_001,
        " ".join(letters(int(n), "abcde") for n in rng.integers(1, 12, 200_000)), "a  b\n \t c" * 100_000, " " * 3000 + "\n" * 5000,
    ]
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    ids = codec.encode(texts)
    for t, x, back in zip(texts, ids, codec.decode(ids), strict=True):
        assert x.tolist() == own.encode_ordinary(t) and back.decode() == t


@pytest.mark.parametrize("stride", [8, 40])
def test_bpe_windows_of_words_meet_at_common_tokens(tik, monkeypatch, stride):
    path, own = tik
    monkeypatch.setattr(bpe, "STRIDE", stride)
    rng = np.random.default_rng(stride)
    words = ["".join(rng.choice(list(of), rng.integers(1, 300))) for of in ("ab", "etaoinshr", "a", "=", "xyzzy") for _ in range(12)]
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    assert [x.tolist() for x in codec.encode(words)] == [own.encode_ordinary(w) for w in words]


def test_bpe_cuts_long_texts_between_words():
    text = "ab  cd\n ef gh\t ij " * 50
    for most in (1, 7, 30):
        parts = bpe.parts_of(text, most)
        assert "".join(parts) == text and len(parts) > 1
        assert all(p[0] == " " and not p[1].isspace() and not q[-1].isspace() for q, p in zip(parts, parts[1:]))


def test_bpe_of_short_and_longer_words_by_their_own_queries(tik, monkeypatch):
    path, own = tik
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list(of), rng.integers(1, 50))) for of in ("ab", "etaoinshr", "a", "=", "aé日", "xyzzy") for _ in range(60)]
    words += [("ab" * 40)[:n] for n in range(bpe.SHORT - 2, bpe.SHORT + 3)]
    want = [own.encode_ordinary(w) for w in words]
    for short in (0, bpe.SHORT, 200):
        monkeypatch.setattr(bpe, "SHORT", short)
        for together in (500, 100_000):
            monkeypatch.setattr(bpe, "TOGETHER", together)
            assert [x.tolist() for x in bpe.Codec(path, public_tokenizers.PATTERN).encode(words)] == want


def test_bpe_looks_a_piece_up_once_a_slice(tik, monkeypatch):
    path, own = tik
    looked = []
    monkeypatch.setattr(bpe.Numbered, "__getitem__", lambda self, k: looked.append(k) or (dict.__getitem__(self, k) if k in self else self.__missing__(k)), raising=False)
    texts = ["so it is " * 300 + "so", "and so it is", "", "a\tb\nc d", " a  b\n c "]
    assert [x.tolist() for x in bpe.Codec(path, public_tokenizers.PATTERN).encode(texts)] == [own.encode_ordinary(t) for t in texts]
    assert len(looked) < 50


def test_spaced_is_what_the_pattern_says():
    rng = np.random.default_rng(6)
    for _ in range(5000):
        text = "".join(rng.choice(list("ab  \n\t\u00a0\u3000\u2028\x1f"), rng.integers(0, 7)))
        assert bpe.spaced(text) == (not re.search(r"\s |^ | \s| $", text)), repr(text)


def test_bpe_of_no_rows(spark, tik):
    empty = frame(spark, ["x"]).limit(0)
    assert bpe.encode(empty, tik[0], public_tokenizers.PATTERN, digests=True).collect() == []


def test_token_counts_equal_the_library(spark, odd_texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = [*odd_texts, "<|endoftext|>a<|startoftext|> b'<|endoftext|>s", "'rx 'r they're ''ll ΑΣ ΑΣΑ İstanbul"]
    got = token_counts.count_tokens(frame(spark, texts), path, 5).collect()
    want = sorted((len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    assert token_counts.count_tokens(frame(spark, texts).limit(0), path).count() == 0


def test_segments_follow_the_splitting_rule():
    rng = np.random.default_rng(3)
    rule = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
    counter = token_counts.counter(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(300):
        text = "".join(rng.choice(list("strvmldexa1!' "), rng.integers(0, 600))) + " "
        chars = np.array([ord(c) for c in text])
        counter.count([text])
        assert np.flatnonzero(token_counts.segment(counter.classes[chars])).tolist() == [m.start() for m in rule.finditer(text)]


def test_media_round_trip(spark, odd_texts):
    got = media.describe(media.store(frame(spark, odd_texts))).collect()
    want = []
    for t in odd_texts:
        raw = (t or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert len({(r.media_sha256, r.feature) for r in got}) == len({t or "" for t in odd_texts})
    assert media.describe(media.store(frame(spark, odd_texts).limit(0))).count() == 0


def test_media_of_all_bytes_and_many_rows():
    rng = np.random.default_rng(2)
    payloads = [rng.integers(0, 256, 64 * n).astype(np.uint8) for n in (1, 3, 8191, 8192, 20000)]
    for p, (pixels, width, height) in zip(payloads, media.thumbnails(media.write_images(payloads)), strict=True):
        assert pixels.tobytes() == p.tobytes() and width == 512 and height == len(p) // 8


def corpus(spark, n=240):
    rng = np.random.default_rng(5)
    words = {"en": "the of and with that from house water".split(), "de": "der die und nicht über schön straße haus".split()}
    rows, labels = [], []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        text = " ".join(rng.choice(words[lang], 60))
        good = int(i % 4 != 0)
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), lang, "s", 1))
        labels.append((i, good, 0))
    rows += [(None, None, "en", "s", 0), (n, "", None, "s", 0), (n + 1, "12 34", "en", "s", 0), (0, rows[0][1], "de", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_learns_and_scores_every_row(spark):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels)
    got = quality.score(docs, model, name="score").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.5) == (r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 240]
    assert np.mean(right) > 0.95
    blank = quality.score(docs, quality.fit(docs, labels.limit(0)), name="score")
    assert {r.score for r in blank.collect()} == {0.5}


def test_isotonic_pools_what_descends():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 4, 2, 4]), np.array([4.0, 4, 4, 4]))
    assert y.tolist() == [0, 0, 0.75, 0.75, 1, 1] and x.tolist() == [1, 1, 2, 3, 4, 4]


def test_language_of_every_row(spark):
    docs, _ = corpus(spark)
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert np.mean([r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 240]) > 0.95
    assert {r.lang_pred for r in got if not any(map(str.isalpha, r.text or ""))} == {"und"}
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_parity_bitmaps_bound_what_two_sets_have_alone():
    from tarnworks.llm.ngram_join import parity

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 6000, np.uint64)
    for _ in range(60):
        a, b = (np.unique(rng.choice(pool, rng.integers(0, 4000))) for _ in range(2))
        differ = int(np.bitwise_count(parity(a) ^ parity(b)).sum())
        assert differ <= len(np.setxor1d(a, b))
    assert not parity(np.zeros(0, np.uint64)).any()
