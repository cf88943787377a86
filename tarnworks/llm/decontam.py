"""Benchmark decontamination by winnowing, in DataFrame functions only.

Fingerprints of a text are the least hashes of its 5-word grams in every 9 consecutive grams, so any two texts that share
13 consecutive words share a fingerprint at the same place of that span. Training and benchmark fingerprints are joined,
each hit gives a diagonal (document position minus item position), and the 13-word windows along it are compared. Items
of fewer than 13 words have one window, their whole; for each of these lengths that occurs, grams of that length are
joined instead.

All work up to the verdict is done once per distinct text, found by two hashes and the length. Null and empty texts have
no words: they count 0 and are clean. Repeated rows each get their row. Items with a null id count as window sources but
not as item ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.session import stash

WINDOW = 13
GRAM = 5
#: ASCII characters that no word has, after lower-casing A-Z.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A fingerprint holds the upper bits of its gram's hash and its place in this many lower bits.
PLACE_BITS = 28


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BREAK), "")


def gram_hashes(words: Column, n: int) -> Column:
    """xxhash64 of every n consecutive words; an empty array for fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, name: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(name, h, at): hash and place of the least gram in each `window - gram + 1` consecutive grams of df's words.

    Each step is a projection of its own: inlined into one expression, arrays would be computed over and over.
    """
    out = df.where(F.size("words") >= window).select(name, gram_hashes(F.col("words"), gram).alias("x"))
    out = out.select(name, F.transform("x", lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("bigint"))).alias("x"))
    width, span = 1, window - gram + 1
    while width < span:
        step = min(width, span - width)
        # the shorter array is filled with nulls, which least() skips: a few narrower windows at the end do no harm
        out = out.select(name, F.zip_with("x", F.slice("x", step + 1, F.greatest(F.size("x"), F.lit(1))), lambda a, b: F.least(a, b)).alias("x"))
        width += step
    place = F.lit((1 << PLACE_BITS) - 1).cast("bigint")
    out = out.select(name, F.explode(F.array_distinct("x")).alias("f"))
    return out.select(name, F.shiftright("f", PLACE_BITS).alias("h"), F.col("f").bitwiseAND(place).cast("int").alias("at"))


def text_key(text: Column) -> Column:
    """Stands for the text: two hashes and its length."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("x"), F.crc32(t).alias("c"), F.octet_length(t).alias("n"))


def _hits(docs: DataFrame, items: DataFrame, short: list[int]) -> DataFrame:
    """(key, item, length, shift): where on a document an item may lie; shift is document place less item place."""
    d, b = fingerprints(docs, "key"), fingerprints(items, "item")
    out = d.join(b.withColumnRenamed("at", "place"), "h").select("key", "item", F.lit(WINDOW).alias("length"), (F.col("at") - F.col("place")).alias("shift"))
    for n in short:
        b = items.where(F.size("words") == n).select("item", F.explode(gram_hashes(F.col("words"), n)).alias("h"))
        d = docs.where(F.size("words") >= n).select("key", F.posexplode(gram_hashes(F.col("words"), n)).alias("shift", "h"))
        out = out.union(d.join(b, "h").select("key", "item", F.lit(n), "shift"))
    return out.distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a benchmark window), n_items, items_sha256 and contaminated.

    items_sha256 is of the ids of items with occurring windows, sorted as strings and joined by commas. A document is
    contaminated if n_hit > 0 and 20 * n_hit >= n_words. Columns of docs with these names are replaced.
    """
    own = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    items = stash(benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.xxhash64(item_text, F.col(item_id)).alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0).distinct(), "items")
    short = sorted(r[0] for r in items.where(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())  # at most 12 lengths
    worded = docs.select(text_key(F.col(text)).alias("key"), words_of(F.col(text)).alias("words"))
    hits = stash(_hits(worded, items, short), "hits")

    # each candidate text once, cut to the parts along its diagonals
    places = hits.groupBy("key").agg(F.collect_list(F.struct("item", "length", "shift")).alias("places"))
    texts = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("t")).join(hits.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("t").alias("t"))
    candidates = texts.join(places, "key").select("key", "places", words_of(F.col("t")).alias("words"))
    lengths = items.select("item", F.size("words").alias("item_words")).distinct()
    sized = candidates.select("key", "words", F.explode("places").alias("p")).select("key", "words", "p.*").join(lengths, "item")
    begin = F.greatest(F.col("shift"), F.lit(0))
    end = F.least(F.size("words"), F.col("shift") + F.col("item_words"))
    cut = sized.where(end - begin >= F.col("length")).select("key", "item", "length", "shift", begin.alias("begin"), F.slice("words", begin + 1, end - begin).alias("part"))
    pair = cut.join(items, "item")
    offset = F.col("begin") - F.col("shift")
    same = F.transform("part", lambda w, i: F.when(w == F.get("words", i + offset), 0).otherwise(1))
    # equal words in a row up to each place: an occurrence ends wherever there are `length` of them
    run = F.aggregate(
        same,
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
        lambda a, s: F.struct(
            F.when(s == 0, a["run"] + 1).otherwise(0).alias("run"),
            (a["at"] + 1).alias("at"),
            F.when((s == 0) & (a["run"] + 1 >= F.col("length")), F.concat(a["ends"], F.array(a["at"] + 1))).otherwise(a["ends"]).alias("ends"),
        ),
        lambda a: a["ends"],
    )
    found = stash(pair.select("key", "item_id", (F.col("begin") - F.col("length")).alias("back"), "begin", "length", run.alias("ends")).where(F.size("ends") > 0), "found")

    spans = found.select("key", "begin", "length", F.explode("ends").alias("e")).select("key", (F.col("begin") + F.col("e") - F.col("length")).alias("a"), (F.col("begin") + F.col("e")).alias("b")).distinct()
    before = F.max("b").over(Window.partitionBy("key").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.select("key", F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce(before, F.lit(0))), F.lit(0)).alias("n")).groupBy("key").agg(F.sum("n").alias("n_hit"))
    named = found.where("item_id IS NOT NULL").select("key", "item_id").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    result = covered.join(named, "key", "left").select("key", "n_hit", F.coalesce(F.size("ids"), F.lit(0)).alias("n"), F.concat_ws(",", "ids").alias("ids"))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    n_words = F.regexp_count(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(BREAK.replace("[", "[^", 1))).cast("bigint")
    wide = docs.select(*kept, text_key(F.col(text)).alias("__key"), n_words.alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("bigint")
    return wide.join(result.withColumnRenamed("key", "__key"), "__key", "left").select(
        *[c for c in kept],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
