"""Substring deduplication: sliding sentence spans.

A text is cut into sentences: they end at a word that ends in ``.``, ``!`` or
``?``, or at a line break. Every run of ``n_sentences`` consecutive sentences
is hashed (words without case, white space aside) and joined over all
documents; one with fewer than ``min_words`` words is lengthened forwards, and
also backwards, until it has them, so that chance repeats of tiny sentences do
not count while both ends of a passage do. Two sentences with ``pair_words``
words, or one with ``long_words``, are runs as well. With 0 for each of the
three, runs are plain ones of ``n_sentences``. A document is its doc_id
and its whole text, the latter as a hash of 128 bits. The first occurrence of
a run, by doc_id, text hash and place, stays; the sentences of every later one
are removed.

Scale: the runs (128 bits of hash, the document and two places each) are
written once to the shared folder. A map-side aggregate finds the hashes that occur
again and where first; an equi-join of the runs with those few hashes gives
the later occurrences, and Spark splits a hash that a third of all documents
share, as it is unique on the other side. Only sums and minima are taken per
hash, never a list of its places. The places to remove meet their document
over its doc_id and text hash; their list is a set, so that it is bounded by
the text's own length however often the row or its doc_id repeats.

Defined results: null and empty texts have no sentence and stay as they are;
a text shorter than a run has none; rows of equal doc_id and text count as
one document, so that exact repeats of a row stay or lose text alike, while
different texts of one doc_id, or of none, are documents of their own. Other
columns are kept; clashing ``n_sentences``
and ``n_removed`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provgraph.llm.common import Scratch, table
from provgraph.llm.hashing import fold_runs, hash_spans, mix, slices, utf8, word_bounds

N_SENTENCES, MIN_WORDS, PAIR_WORDS, LONG_WORDS = 3, 15, 40, 50
#: What tells documents apart.
KEY = ["doc_id", "__text_a", "__text_b"]
#: What tells runs apart.
HASH = ["hash_a", "hash_b"]
#: Runs in a batch that goes back to Spark.
ROWS = 50_000
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words; first word and end word of each
    sentence; n + 1 sentence offsets by row."""
    starts, ends = word_bounds(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return starts, ends, none, none, np.zeros(len(offsets), np.int64)
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    last = _STOP[data[ends - 1]]
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    stop = np.flatnonzero(last) + 1
    first = np.concatenate(([0], stop[:-1]))
    return starts, ends, first, stop, np.searchsorted(first, bounds)


def runs(data: np.ndarray, offsets: np.ndarray, n_sentences: int, min_words: int, pair_words: int, long_words: int) -> tuple[np.ndarray, ...]:
    """(row, first sentence, sentences, two hashes) of every run."""
    starts, ends, first, stop, bounds = sentences(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    here, low, high = np.arange(len(first)), bounds[:-1][row], bounds[1:][row]
    after = np.searchsorted(stop, first + min_words)  # last sentence of a run that starts here
    before = np.searchsorted(first, stop - min_words, "right") - 1  # first one of a run that ends here
    pair = np.minimum(here + 1, len(first) - 1)
    whole = here[(stop - first >= long_words) & (long_words > 0)], here[(stop[pair] - first >= pair_words) & (pair_words > 0)]
    from_ = np.concatenate((here, np.minimum(before, here - n_sentences + 1), *whole))
    to = np.concatenate((np.maximum(after, here + n_sentences - 1), here, whole[0], whole[1] + 1))
    of = np.concatenate((here, here, *whole))
    ok = (from_ >= low[of]) & (to < high[of])
    both = np.unique(np.column_stack((from_[ok], to[ok])), axis=0) if ok.any() else np.zeros((0, 2), np.int64)
    from_, to = both[:, 0], both[:, 1]
    words = hash_spans(data, starts, ends) if len(from_) else np.zeros(0, np.uint64)
    hashes = [fold_runs(w, first[from_], stop[to]) if len(from_) else w for w in (words, mix(words ^ np.uint64(0xB492B66FBE98F273)))]
    return row[from_], from_ - bounds[row[from_]], to - from_ + 1, *hashes


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the two halves of its text's hash."""
    return docs.withColumns({KEY[1]: F.xxhash64("text"), KEY[2]: F.xxhash64(F.lit(2), F.col("text"))})


def span_table(docs: DataFrame, n_sentences: int = N_SENTENCES, min_words: int = MIN_WORDS, pair_words: int = PAIR_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(*KEY, place, n, *HASH) of every run of every document."""
    docs = keyed(docs).select(*KEY, "text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, len(KEY)):
                data, offsets = utf8(batch.column(len(KEY)))
                row, place, n, *hashes = runs(data, offsets, n_sentences, min_words, pair_words, long_words)
                for at in range(0, len(row), ROWS):
                    part = slice(at, at + ROWS)
                    of = pa.array(row[part])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(of) for i in range(len(KEY))), pa.array(place[part].astype(np.int32)), pa.array(n[part].astype(np.int32)), *(pa.array(h[part].view(np.int64)) for h in hashes)],
                        names=[*KEY, "place", "n", *HASH],
                    )

    return docs.mapInArrow(run, T.StructType([T.StructField(c, docs.schema[c].dataType) for c in KEY]).add("place", "integer").add("n", "integer").add(HASH[0], "long").add(HASH[1], "long"))


def later_spans(spans: DataFrame, scratch: Scratch) -> DataFrame:
    """(*KEY, place, n) of the occurrences that are not a run's first."""
    at = F.struct(*KEY, "place")
    ends = spans.groupBy(*HASH).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    again = ends.filter("first != last").select(*(F.col(h).alias(f"__{h}") for h in HASH), "first")
    again = scratch.save(again)  # a table of its own, so that a hot hash can be split
    same = (F.col(HASH[0]) == F.col(f"__{HASH[0]}")) & (F.col(HASH[1]) == F.col(f"__{HASH[1]}"))
    return spans.join(again, same).filter(~at.eqNullSafe(F.col("first"))).select(*KEY, "place", "n")


def without(column: pa.Array, places: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts without the sentences of their places, sentences, removed ones).

    places: for each text a list of place * 2**32 + n, or null.
    """
    data, offsets = utf8(column)
    starts, _, first, _, bounds = sentences(data, offsets)
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    begin = starts[first] if len(first) else np.zeros(0, np.int64)
    end = np.concatenate((begin[1:], offsets[-1:])) if len(first) else begin
    some = np.flatnonzero(np.diff(bounds))
    end[bounds[1:][some] - 1] = offsets[1:][some]  # the last one of a text goes to its end
    held = np.asarray(places.flatten(), np.int64)
    of = np.repeat(np.arange(len(places)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(places), 0)))
    edge = np.zeros(len(first) + 1, np.int64)
    np.add.at(edge, bounds[:-1][of] + (held >> 32), 1)
    np.add.at(edge, bounds[:-1][of] + (held >> 32) + (held & 0xFFFFFFFF), -1)
    gone = np.cumsum(edge)[:-1] > 0
    removed = np.bincount(row[gone], minlength=len(column))
    if not gone.any():
        return column, np.diff(bounds), removed
    keep = np.ones(len(data), bool)
    for s, e in zip(begin[gone].tolist(), end[gone].tolist()):
        keep[s:e] = False
    lost = np.bincount(row[gone], (end - begin)[gone], len(column)).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(np.diff(offsets) - lost)))
    texts = pa.StringArray.from_buffers(len(column), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[keep].tobytes()))
    return pa.compute.if_else(column.is_null(), pa.scalar(None, pa.string()), texts), np.diff(bounds), removed


def remove_repeats(docs: DataFrame, **sizes: int) -> DataFrame:
    """``docs`` without repeated sentences, with n_sentences and n_removed."""
    kept = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")]
    docs = docs.select(*kept)
    scratch, result = Scratch(docs.sparkSession, "spans"), Scratch(docs.sparkSession, "spans-result")
    spans = scratch.save(span_table(docs, **sizes))
    packed = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    places = later_spans(spans, scratch).groupBy(*KEY).agg(F.collect_set(packed).alias("places"))
    places = result.save(places.select(*(F.col(c).alias(f"__of_{c}") for c in KEY), F.col("places").alias("__places")))
    scratch.drop()
    same = F.col("doc_id").eqNullSafe(F.col("__of_doc_id"))
    for c in KEY[1:]:
        same &= F.col(c) == F.col(f"__of_{c}")
    rows = keyed(docs).join(places, same, "left").select(*kept, "__places")
    at = kept.index("text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, at):
                texts, n, removed = without(batch.column(at), batch.column(len(kept)))
                arrays = [texts if i == at else c for i, c in enumerate(batch.columns[:-1])]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n), pa.array(removed, pa.int64())], names=[*kept, "n_sentences", "n_removed"])

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields]).add("n_sentences", "long").add("n_removed", "long"))


def op10_sentence_spans(spark, sf_dir: str) -> DataFrame:
    """Every document without the sentences of repeated spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_sentences", "n_removed", "text")
