"""Quality rules: hashed n-gram log-likelihood ratio (native).

Two multinomials over ``2**bits`` buckets of hashed n-grams are counted: one over every
document (the raw corpus), one over trusted documents (the target). Each
document's score is the mean, over its unigrams and bigrams, of
``log p_target - log p_raw``; a document is kept if the score reaches the
threshold and the base rules hold.

Scale: one pass counts, with map-side sums over ``2**bits`` keys, so the
shuffle is at most 2**bits rows a task; of the documents with an id, those
that a map of 2**``MAP_BITS`` bits does not rule out meet all trusted ids in an
equi-join, which shuffles their texts (a sort-merge join at any size, so that
small runs tell what large ones need; with very many trusted ids the map rules
out few); one pass scores, without a shuffle. The weights (2**bits doubles)
and that map are the only things the driver sends to executors.

Defined results: null text counts as empty and fails the base rules; with no
trusted document, or no n-gram in the corpus, every weight is 0, so that the
base rules alone decide; repeated doc_ids are judged row by row; other
columns, whatever their names, are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.llm.common import SPACE, text_of, words

#: Runs of letters and digits, or of other visible characters.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
BITS, THRESHOLD = 14, -0.25
#: Size of the map of trusted ids: 16,384 words of 64 bits.
MAP_BITS = 20
PREFIX = "__rules_"


def token_hashes(text: Column) -> Column:
    """Array of the 64-bit hashes of the tokens of ``text``."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def _pairs(hashes: Column, reach: int = 1) -> tuple[Column, Column]:
    """The array without its last, and without its first ``reach`` items."""
    n = F.greatest(F.size(hashes) - reach, F.lit(0))
    return F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + reach), n)


def _bucket(bits: int, *hashes: Column) -> Column:
    return F.shiftrightunsigned(hashes[0] if len(hashes) == 1 else F.xxhash64(*hashes), 64 - bits).cast("int")


def trusted_ids(docs_or_labels: DataFrame) -> DataFrame:
    """The distinct ids of trusted rows."""
    return docs_or_labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias(PREFIX + "id")).distinct()


def _constant(numbers: list, kind: str) -> Column:
    """An array of numbers that the plan folds into a constant."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast(f"array<{kind}>")


def may_be_trusted(ids: DataFrame, column: Column, bits: int = MAP_BITS) -> Column:
    """Whether a number may be one of ``ids``: never false for one that is."""
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c.cast("string")), 64 - bits)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), slot(c).bitwiseAND(F.lit(63)).cast("int"))
    own = ids[ids.columns[0]]
    found = ids.groupBy(F.shiftright(slot(own), 6).alias("word")).agg(F.bit_or(bit(own)).alias("held")).collect()  # 2**(bits - 6) rows at most
    held = [0] * (1 << (bits - 6))
    for r in found:
        held[r.word] = r.held
    return F.get(_constant(held, "bigint"), F.shiftright(slot(column), 6).cast("int")).bitwiseAND(bit(column)) != 0


def ngram_weights(docs: DataFrame, labels: DataFrame, bits: int = BITS, smoothing: float = 1.0) -> list[float]:
    """log p_target - log p_raw of each bucket, from all documents."""
    n_buckets = 1 << bits
    texts = docs.select(docs["doc_id"].alias(PREFIX + "id"), text_of(docs).alias("text"))
    ids = trusted_ids(labels)
    may = F.coalesce(may_be_trusted(ids, F.col(PREFIX + "id")), F.lit(False))
    asked = texts.filter(may).join(ids.withColumn("trusted", F.lit(1)).hint("merge"), PREFIX + "id", "left")
    rows = asked.select("trusted", "text").union(texts.filter(~may).select(F.lit(None).cast("int"), "text"))
    rows = rows.select("trusted", token_hashes(F.col("text")).alias("hashes"))
    # each token with its successor; the last one's is null
    grams = rows.select("trusted", F.inline(F.arrays_zip(F.col("hashes").alias("a"), F.slice("hashes", 2, 2**31 - 1).alias("b"))).alias("a", "b"))
    both = F.array(_bucket(bits, F.col("a")), F.when(F.col("b").isNotNull(), _bucket(bits, F.col("a"), F.col("b"))))
    grams = grams.select("trusted", F.explode(both).alias("bucket")).filter("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    found = counts.collect()  # 2**bits rows at most
    raw_total, target_total = sum(c.raw for c in found), sum(c.target for c in found)
    weights = [0.0] * n_buckets
    for c in found if target_total else []:
        target = (c.target + smoothing) / (target_total + smoothing * n_buckets)
        weights[c.bucket] = math.log(target) - math.log((c.raw + smoothing) / (raw_total + smoothing * n_buckets))
    return weights


def base_columns(text: Column, w: Column) -> dict[str, Column]:
    """The base counts, from a text and the array of its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def _windows(hashes: Column) -> Column:
    """Hashes of all windows of three words."""
    two = F.zip_with(*_pairs(hashes), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(F.slice(two, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0))), _pairs(hashes, 2)[1], lambda p, c: F.xxhash64(p, c))


#: Up to so many different repeated windows, membership is tested one by one.
FEW = 64


def _with_repeats(rows: DataFrame, windows: str, out: str) -> DataFrame:
    """``rows`` with the number of words in windows whose hash occurs again."""
    ordered, twice = PREFIX + "ordered", PREFIX + "twice"
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    spread = lambda starts: F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    w = F.col(windows)
    rows = rows.withColumn(ordered, F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(w)))
    rows = rows.withColumn(twice, F.array_distinct(some(F.zip_with(*_pairs(F.col(ordered)), lambda a, b: F.when(a == b, a)))))
    found = some(F.transform(w, lambda h, i: F.when(F.array_contains(twice, h), i)))
    # many different ones: sorted with their places, equal neighbours repeat
    placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = some(F.zip_with(*_pairs(placed), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
    count = F.when(F.col(twice).isNull(), 0).when(F.size(twice) <= FEW, spread(found)).otherwise(spread(F.array_distinct(F.flatten(pairs))))
    return rows.withColumn(out, count.cast("long"))


def quality_rules(docs: DataFrame, weights: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with base counts, ``score``, ``base_failed`` and ``kept``.

    Columns of ``docs`` that bear one of those names are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    keep = [c for c in docs.columns if c.lower() not in names]
    bits = len(weights).bit_length() - 1
    table = _constant(weights, "double")
    rows = docs.select(*[docs[c] for c in keep], text_of(docs).alias(PREFIX + "text"))
    text = rows[PREFIX + "text"]
    rows = rows.withColumn(PREFIX + "words", words(text)).withColumn(PREFIX + "hashes", token_hashes(text))
    rows = rows.withColumn(PREFIX + "windows", F.transform(PREFIX + "words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn(PREFIX + "windows", _windows(rows[PREFIX + "windows"]))
    hashes = rows[PREFIX + "hashes"]
    total = F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.get(table, _bucket(bits, h)))
    total += F.aggregate(F.zip_with(*_pairs(hashes), lambda a, b: F.get(table, _bucket(bits, a, b))), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumns(base_columns(text, rows[PREFIX + "words"]) | {"score": F.when(F.size(hashes) == 0, 0.0).otherwise(total / (2 * F.size(hashes) - 1))})
    rows = _with_repeats(rows, PREFIX + "windows", "n_repeat_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return rows.select(*keep, *names)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every document."""
    from provgraph.llm.common import table

    docs = table(spark, sf_dir, "documents")
    judged = quality_rules(docs, ngram_weights(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
