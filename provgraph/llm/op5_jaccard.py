"""N-gram Jaccard join: size-aware, with light and heavy sets.

A document is the set of its distinct five-word shingles; two documents link
when their sets' Jaccard similarity is at least ``percent`` / 100. The result
gives each document the smallest doc_id that links reach.

Equal sets are one class from the start, told apart by 128 bits of hash and
their size. A class of which fewer than ``percent`` % of the shingles stand in
another class as well can link to nothing and is done. Of the others, by size:

* light sets (at most the boundary): all subsets of the fixed size that a
  pair of given sizes has to share are enumerated, each as a hash of 128 bits.
  Two sets with a subset in common link, by arithmetic, without a further
  check;
* heavy sets: inverted lists over the rarest shingles of each set. Two sets
  that link share a shingle among their n - ceil(n * percent / 100) + 1 first
  in any one order of all shingles; here frequent ones come last. Sets that
  meet in a list are compared in full.

The boundary is the size at which enumeration starts to cost more than the
scan, from the numbers of sets by size and the mean list length; it is at most
``MAX_LIGHT``, as the number of subsets multiplies with the size, and a larger
set is found by the lists whatever the boundary.

Links are needed up to reachability, so the pairs of a list are not all made:
a round compares each set with one leader of its lists; sets that have become
one component are then one; what still meets across components after
``rounds`` rounds is compared pair by pair, except pairs that two exact bounds
rule out: shingles that no other set has, and parity bits in which the sets
differ. No link between components is lost, and a group of near copies costs
its size, not its square. Only a group whose sets nearly link, and none of
which does, costs a bit comparison (no row) for each pair of a list.

Scale: texts are read in three passes and never shuffled. What is broadcast
grows with the data up to a bound: at least eight bits for each class of equal
sets, one for each shingle (of which those in several classes are marked), and
a byte for eight shingles, which orders the lists; 2**31 bits and 2**28 bytes
at most, which some 10^9 shingles in several classes fill to a half. They only
spare work: fuller ones let more sets pass to the lists, never fewer. The counts behind them are of every
shingle of every class; a task combines its own first, and the number of
ranges that they are dealt to follows their number, so that a range stays
small. Hot lists are split by Spark's skew join. Nothing else comes to the
driver but a few counts.

Defined results: null and empty texts have n_shingles 0, link to nothing and
are their own component; fewer than five words are one shingle; repeated rows
of one doc_id are one document each and share the component if their text is
equal; a null doc_id has a null component; an empty table gives no row; other
columns of the input are not used.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provgraph.llm.common import SPACE, Scratch, small_batches, table
from provgraph.llm.components import connected_components
from provgraph.llm.hashing import PART, mix, slices, unique_by_row, windows, words_of

SHINGLE, PERCENT = 5, 80
ROUNDS, MAX_LIGHT = 3, 24
#: Most bits of the maps' sizes: 2**31 bits and 2**28 bytes are 256 MB each.
MOST_BITS, MOST_RANKS = 31, 28
#: Shingles are counted by their first so many bits, in ranges of about so many.
TOKEN_BITS, RANGE = 40, 4_000_000
#: Words of 64 parity bits that a set is summed up in.
PARITIES = 16


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and n + 1 offsets."""
    hashes, bounds, _, _ = words_of(column)
    return unique_by_row(*windows(hashes, bounds, size))


def _wide(first: np.ndarray, second: np.ndarray) -> pa.Array:
    """128-bit numbers as binaries of 16 bytes."""
    held = np.column_stack((first, second)).astype(">u8").tobytes()
    offsets = np.arange(len(first) + 1, dtype=np.int32) * 16
    return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(held)])


def set_ids(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, the same for equal sets."""
    n = np.diff(bounds).astype(np.uint64)
    both = []
    for seed in (0x51ED270B, 0xB492B66FBE98F273):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(seed)), dtype=np.uint64)))
        both.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + n * np.uint64(0x9E3779B97F4A7C15)))
    return both[0], both[1]


def map_size(numbers: int, most: int) -> int:
    """Bits of the size of a map for so many numbers, 20 at least."""
    return min(most, max(20, int(numbers).bit_length()))


def least_overlap(n, m, percent: int = PERCENT):
    """The fewest shared shingles of linked sets of n and m shingles."""
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int = PERCENT) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subsets_of(n: int, percent: int = PERCENT) -> int:
    """How many subsets enumeration makes for a set of n shingles."""
    return sum(comb(n, c) for m in partner_sizes(n, percent) if (c := least_overlap(n, m, percent)) <= n)


def prefix_size(n, percent: int = PERCENT):
    return n + (-percent * n // 100) + 1


def boundary(sizes: dict[int, int], mean_list: float, percent: int = PERCENT, most: int = MAX_LIGHT) -> int:
    """The largest light size: below it enumeration costs less in total.

    A subset costs one row. A scanned shingle costs about four (counted,
    looked up, joined, led) times its list, and a comparison the set itself.
    """
    gain, best, total = 0, 0.0, 0.0
    for n in range(1, most + 1):
        total += sizes.get(n, 0) * (4 * prefix_size(n, percent) * mean_list + n - subsets_of(n, percent))
        if total >= best:
            gain, best = n, total
    return gain


def parities(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """PARITIES numbers for each set: its shingles dealt to bits by hash, each
    of which says whether it got an odd number. Two sets differ in at least as
    many shingles as they do in these bits."""
    n, width = len(bounds) - 1, 64 * PARITIES
    row = np.repeat(np.arange(n), np.diff(bounds))
    bit = (mix(values ^ np.uint64(0xA5A5A5A5)) % np.uint64(width)).astype(np.int64)
    odd = np.zeros((n, width), np.uint8)
    for at in range(0, n, 1024):  # by parts, as the counts are wide
        a, z = bounds[at], bounds[min(at + 1024, n)]
        part = min(1024, n - at)
        odd[at : at + part] = (np.bincount((row[a:z] - at) * width + bit[a:z], minlength=part * width) & 1).reshape(part, width)
    return np.packbits(odd, axis=1).view(np.int64)


class BitMap:
    """Which of 2**bits classes of numbers occur; bounded, may say too much."""

    def __init__(self, numbers: DataFrame, column: str, bits: int):
        slot = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
        words = numbers.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("m"))
        found = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # 2**(bits - 6) rows at most
        self.words = np.zeros(1 << (bits - 6), np.int64)
        self.words[found.column("w").to_numpy()] = found.column("m").to_numpy()


def _numbers(ids: pa.Array) -> np.ndarray:
    return np.asarray(ids.cast(pa.int64()))


def _xxhash(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 (seed 42) of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = np.uint64(42) + p5 + np.uint64(8)
    h = h ^ (rot(x.view(np.uint64) * p2, 31) * p1)
    h = rot(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _within(words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    slot = _xxhash(numbers) >> np.uint64(64 - (len(words).bit_length() - 1 + 6))
    return (words[(slot >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (slot & np.uint64(63))) & np.uint64(1) == 1


def text_keys(docs: DataFrame) -> list:
    """Two columns that tell texts apart."""
    return [F.xxhash64(docs["text"]).alias("__text_a"), F.xxhash64(F.lit(2), docs["text"]).alias("__text_b")]


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, two keys of the text, n, sid) of every document."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 3, PART):
                values, bounds = shingle_sets(batch.column(3))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(bounds).astype(np.int32)), _wide(*set_ids(values, bounds))], names=["doc_id", "__text_a", "__text_b", "n", "sid"])

    return docs.select("doc_id", *text_keys(docs), "text").mapInArrow(run, "doc_id long, __text_a long, __text_b long, n int, sid binary")


def _pack(x: np.ndarray) -> bytes:
    """Sorted numbers below 2**40, by differences and byte planes."""
    d = np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(5, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :5] = planes.T
    return np.cumsum(d.view(np.uint64).ravel(), dtype=np.uint64)


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, rising, and how often each occurs; sorts ``x``."""
    x.sort()
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[first], np.diff(first, append=len(x))


def merged(packed, places, counts) -> tuple[np.ndarray, np.ndarray]:
    """The same of packed parts, of which each has the places of the numbers
    that stand for several and their counts; what is large is held once."""
    ends = np.cumsum([zstandard.frame_content_size(h) // 5 for h in packed])
    x, often, more = np.empty(ends[-1], np.uint64), [], []
    for held, at, n, end in zip(packed, places, counts, ends.tolist()):
        own = _unpack(held)
        x[end - len(own) : end] = own
        often.append(own[np.frombuffer(at, np.int32)])
        more.append(np.frombuffer(n, np.int64) - 1)
    x, n = counted(x)
    np.add.at(n, np.searchsorted(x, np.concatenate(often)), np.concatenate(more))
    return x, n


class Known:
    """What is known of shingles by their first bits: which stand in several
    classes (perhaps more than do), and how frequent they are."""

    def __init__(self, shared: np.ndarray, ranks: np.ndarray):
        self.shared, self.ranks = shared, ranks

    def is_shared(self, values: np.ndarray) -> np.ndarray:
        at = values >> np.uint64(64 - (len(self.shared).bit_length() - 1 + 3))
        return (self.shared[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def rank(self, values: np.ndarray) -> np.ndarray:
        return self.ranks[(values >> np.uint64(64 - (len(self.ranks).bit_length() - 1))).astype(np.int64)]


def count_shingles(docs: DataFrame, only, total: int, map_bits: int, rank_bits: int, flush: int = 1 << 21) -> tuple[Known, float]:
    """(Known, mean list length) from every shingle of every class.

    only: a bit map of the doc_ids that stand for a class; total: about how
    many shingles there are.
    """
    spark = docs.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    range_bits = min((least - 1).bit_length(), rank_bits, map_bits - 3)
    low = np.uint64(TOKEN_BITS - range_bits)

    def spread(batches):
        def put(held):
            x = np.concatenate(held)
            held.clear()
            x, n = counted(x)
            cut = np.searchsorted(x >> low, np.arange((1 << range_bits) + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                own, of = x[cut[p] : cut[p + 1]], n[cut[p] : cut[p + 1]]
                often = np.flatnonzero(of > 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([_pack(own)], pa.binary()), pa.array([often.tobytes()], pa.binary()), pa.array([of[often].astype(np.int64).tobytes()], pa.binary())],
                    names=["part", "held", "places", "counts"],
                )

        held, n = [], 0
        for whole in batches:
            whole = whole.filter(pa.array(_within(only.value, _numbers(whole.column(0)))))
            for batch in slices(whole, 1, PART):
                values, _ = shingle_sets(batch.column(1))
                held.append(values >> np.uint64(64 - TOKEN_BITS))
                n += len(values)
                if n >= flush:
                    yield from put(held)
                    n = 0
        if n:
            yield from put(held)

    def count(rows):
        import pandas as pd

        x, n = merged(rows["held"], rows["places"], rows["counts"])
        part, again = int(rows["part"].iloc[0]), n > 1
        base = np.uint64(part << int(low))
        ranks = np.zeros(1 << (rank_bits - range_bits), np.uint8)
        level = np.minimum(np.round(8 * np.log2(n[again])), 255).astype(np.uint8)
        np.maximum.at(ranks, ((x[again] - base) >> np.uint64(TOKEN_BITS - rank_bits)).astype(np.int64), level)
        bits = np.zeros(1 << (map_bits - range_bits), np.uint8)
        bits[((x[again] - base) >> np.uint64(TOKEN_BITS - map_bits)).astype(np.int64)] = 1
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return pd.DataFrame({"part": [part], "ranks": [squeeze(ranks.tobytes())], "bits": [squeeze(np.packbits(bits, bitorder="little").tobytes())], "n": [len(x)], "total": [int(n.sum())]})

    blobs = docs.select("doc_id", "text").mapInArrow(spread, "part int, held binary, places binary, counts binary")
    ranks, shared = np.zeros(1 << rank_bits, np.uint8), np.zeros(1 << (map_bits - 3), np.uint8)
    distinct = seen = 0
    with small_batches(spark):
        # bounded by the two maps' sizes
        for r in blobs.groupBy("part").applyInPandas(count, "part int, ranks binary, bits binary, n long, total long").toLocalIterator():
            for out, held in ((ranks, r.ranks), (shared, r.bits)):
                width = len(out) >> range_bits
                out[r.part * width : (r.part + 1) * width] = np.frombuffer(zstandard.decompress(bytes(held)), np.uint8)
            distinct, seen = distinct + r.n, seen + r.total
    return Known(shared, ranks), seen / max(1, distinct)


CANDIDATES = (
    T.StructType().add("sid", "binary").add("n", "integer").add("u", "integer").add("known", "integer")
    .add("tokens", T.ArrayType(T.LongType())).add("keys", T.ArrayType(T.StructType().add("key", "binary").add("small", "boolean"))).add("parity", T.ArrayType(T.LongType())).add("held", "binary")
)


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def subset_keys(values: np.ndarray, bounds: np.ndarray, most: int, percent: int = PERCENT) -> pa.Array:
    """For each set of at most ``most`` shingles, its subsets' (key, small)."""
    picks: dict[tuple[int, int], np.ndarray] = {}
    n, first, second, small, counts = np.diff(bounds), [], [], [], np.zeros(len(bounds) - 1, np.int64)
    for i in np.flatnonzero((n > 0) & (n <= most)).tolist():
        own, k = values[bounds[i] : bounds[i + 1]], int(n[i])
        for m in partner_sizes(k, percent):
            c = least_overlap(k, m, percent)
            if m > most or c > min(k, m):
                continue
            if (k, c) not in picks:
                picks[k, c] = np.array(list(combinations(range(k), c)))
            of = np.uint64(min(k, m) * 1000 + max(k, m))
            for out, seed in ((first, 0x2545F491), (second, 0xD1342543DE82EF95)):
                out.append(mix(mix(own ^ np.uint64(seed))[picks[k, c]].sum(1, dtype=np.uint64) + of))
            small.append(np.full(len(first[-1]), k <= m))
            counts[i] += len(first[-1])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return _lists(pa.StructArray.from_arrays([_wide(join(first, np.uint64), join(second, np.uint64)), pa.array(join(small, bool))], ["key", "small"]), counts)


def candidates(docs: DataFrame, only, known, light: int, percent: int = PERCENT) -> DataFrame:
    """The classes that may link, with all that is asked of them later.

    u: how many of its shingles no other class has, at least; known: how much
    of its list part, in tenths, others have; tokens: its inverted lists;
    keys: its subsets.
    """
    least = percent * light // 100  # smaller sets cannot link to a heavy one

    def run(batches):
        for whole in batches:
            whole = whole.filter(pa.array(_within(only.value, _numbers(whole.column(0)))))
            for batch in slices(whole, 1, PART):
                values, bounds = shingle_sets(batch.column(1))
                n = np.diff(bounds)
                shared = known.value.is_shared(values)
                seen = np.concatenate(([0], np.cumsum(shared)))
                s = seen[bounds[1:]] - seen[bounds[:-1]]
                may = np.flatnonzero((n > 0) & (100 * s >= percent * n))
                if not len(may):
                    continue
                chosen = np.zeros(len(n), bool)
                chosen[may] = True
                take = np.repeat(chosen, n)
                values, shared, n, s = values[take], shared[take], n[may], s[may]
                bounds = np.concatenate(([0], np.cumsum(n)))
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((values, known.value.rank(values), shared, row))
                place = np.arange(len(values)) - bounds[:-1][row]
                listed = shared[order] & (place < prefix_size(n, percent)[row]) & (n > least)[row]
                counts = np.bincount(row[listed], minlength=len(n))
                part = np.bincount(row[shared[order] & (place < prefix_size(n, percent)[row])], minlength=len(n))
                arrays = [
                    _wide(*set_ids(values, bounds)), pa.array(n.astype(np.int32)), pa.array((n - s).astype(np.int32)), pa.array((10 * part // prefix_size(n, percent)).astype(np.int32)),
                    _lists(pa.array(values[order][listed].view(np.int64)), counts), subset_keys(values, bounds, light, percent), _lists(pa.array(parities(values, bounds).ravel()), np.full(len(n), PARITIES)),
                    pa.array([values[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:])], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=CANDIDATES.names)

    return docs.select("doc_id", "text").mapInArrow(run, CANDIDATES).dropDuplicates(["sid"])


def light_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all light sets that link, by subsets."""
    rows = sets.select("sid", F.inline("keys"))
    hubs = rows.groupBy("key").agg(F.min(F.when(F.col("small"), F.col("sid"))).alias("hub"), F.min("sid").alias("lo"), F.max("sid").alias("hi"))
    hubs = hubs.filter("hub is not null and lo != hi").select(F.col("key").alias("k"), "hub")
    return rows.join(hubs, F.col("key") == F.col("k")).filter("sid != hub").select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(c, d): the components of those pairs (a, b) whose sets link."""
    left = pairs.join(sets.select(F.col("sid").alias("a"), F.col("held").alias("ha")), "a")
    both = left.join(sets.select(F.col("sid").alias("b"), F.col("held").alias("hb")), "b").select("c", "d", "ha", "hb")

    def run(batches):
        for batch in batches:
            ha, hb = batch.column(2), batch.column(3)
            ok = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x, y = np.frombuffer(ha[i].as_buffer(), np.uint64), np.frombuffer(hb[i].as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return both.mapInArrow(run, "c binary, d binary").distinct()


def _near(percent: int):
    """Whether sets of n and m shingles, u and v of them in no other set, may
    link: they share at most min(n - u, m - v)."""
    most = F.least(F.col("n") - F.col("u"), F.col("m") - F.col("v"))
    return (100 + percent) * most >= percent * (F.col("n") + F.col("m"))


def _meet(postings: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b, c, d): each set with one leader of another component from its
    lists, and their components.

    Leaders are drawn anew each turn from those sets of a list whose first
    shingles are the most widely known: the originals of copies, rather than
    copies with changes of their own.
    """
    lead = F.struct("sid", "n", "u", "c")
    rank = F.struct((-F.col("known")).alias("k"), F.xxhash64("sid", F.lit(turn)).alias("h"), lead.alias("lead"))
    leads = postings.groupBy("token").agg(F.min(rank)["lead"].alias("lead"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    leads = leads.filter("lo != hi").select(F.col("token").alias("t"), F.col("lead.sid").alias("b"), F.col("lead.n").alias("m"), F.col("lead.u").alias("v"), F.col("lead.c").alias("d"))
    met = postings.join(leads, (F.col("token") == F.col("t")) & (F.col("c") != F.col("d")) & _near(percent))
    often = met.groupBy("sid", "c", "b", "d").agg(F.count(F.lit(1)).alias("often"))
    return often.groupBy("sid", "c").agg(F.max(F.struct("often", "b", "d")).alias("x")).select(F.col("sid").alias("a"), "x.b", "c", "x.d")


def _renamed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with column c mapped through labels (v, c)."""
    to = labels.select("v", F.col("c").alias("to"))
    return rows.join(to, F.col("c") == F.col("v"), "left").withColumn("c", F.coalesce("to", "c")).drop("v", "to")


def _mixed(postings: DataFrame) -> DataFrame:
    """Postings of lists with several components."""
    lists = postings.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select(F.col("token").alias("t"))
    return postings.join(lists, F.col("token") == F.col("t"), "left_semi")


def join_groups(docs: DataFrame, percent: int = PERCENT, map_bits: int = MOST_BITS, rank_bits: int = MOST_RANKS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, two keys of the text, n_shingles, component_id, group) of every
    document. The group is the component itself, null without a doc_id or
    words: two components have the same component_id if one doc_id stands on
    texts of both."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    scratch, kept = Scratch(spark, "jaccard"), Scratch(spark, "jaccard-result")
    own = kept.save(classes(docs))
    with_id = docs.filter("doc_id is not null")
    stand = scratch.save(own.filter("doc_id is not null and n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("doc_id")))
    size = stand.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    total = size.n
    # the maps grow with what they hold: classes, shingles, and ranks, of which fewer do
    map_bits, rank_bits = map_size(total, map_bits), map_size(total // 8, rank_bits)
    # the first document of each class stands for it
    only = spark.sparkContext.broadcast(BitMap(stand, "doc_id", map_size(8 * size.k, MOST_BITS)).words)
    found, mean_list = count_shingles(with_id, only, total, map_bits, rank_bits)
    known = spark.sparkContext.broadcast(found)
    by_size = stand.filter(F.col("n") <= MAX_LIGHT).groupBy("n").agg(F.count("sid").alias("k"))
    light = boundary({r.n: r.k for r in by_size.collect()}, mean_list, percent)
    sets = scratch.save(candidates(with_id, only, known, light, percent))
    only.unpersist()
    known.unpersist()

    labels = connected_components(light_links(sets), scratch)
    nodes = scratch.save(_renamed(sets.select("sid", F.col("sid").alias("c")), labels))
    postings = sets.select("sid", "n", "u", "known", F.explode("tokens").alias("token"))
    postings = scratch.save(_mixed(postings.join(nodes.withColumnRenamed("sid", "s"), F.col("sid") == F.col("s")).drop("s")))
    for turn in range(rounds):
        fresh = scratch.save(verify(_meet(postings, turn, percent), sets, percent))
        if fresh.isEmpty():
            break
        labels = connected_components(fresh.toDF("a", "b"), scratch)
        nodes = scratch.save(_renamed(nodes, labels))
        postings = scratch.save(_mixed(_renamed(postings, labels)))
    # what still meets across components, pair by pair
    postings = scratch.save(postings.drop("known").join(sets.select(F.col("sid").alias("s"), "parity"), F.col("sid") == F.col("s")).drop("s"))
    other = postings.withColumnsRenamed({"token": "t", "sid": "b", "n": "m", "u": "v", "c": "d", "parity": "parities"})
    differ = F.lit(0)
    for k in range(PARITIES):
        differ += F.bit_count(F.get("parity", F.lit(k)).bitwiseXOR(F.get("parities", F.lit(k))))
    # sets that link differ in at most n + m less twice their least overlap
    alike = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("m"))
    pairs = postings.join(other, (F.col("token") == F.col("t")) & (F.col("c") != F.col("d")) & (F.col("sid") < F.col("b")) & _near(percent) & alike)
    fresh = scratch.save(verify(pairs.select(F.col("sid").alias("a"), "b", "c", "d").distinct(), sets, percent))
    nodes = _renamed(nodes, connected_components(fresh.toDF("a", "b"), scratch))
    # classes first: copies meet their class's row, hot or not, by a join
    named = stand.join(nodes.withColumnRenamed("sid", "s"), F.col("sid") == F.col("s"), "left").select("sid", "n", "doc_id", F.coalesce("c", "sid").alias("c"))
    named = scratch.save(named)
    first = named.groupBy("c").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("c", "k")
    named = kept.save(named.join(first, F.col("c") == F.col("k")).select(F.col("sid").alias("s"), F.col("n").alias("m"), "component_id", F.col("c").alias("group")))
    scratch.drop()
    rows = own.join(named, (F.col("sid") == F.col("s")) & (F.col("n") == F.col("m")) & F.col("doc_id").isNotNull(), "left")
    return rows.select("doc_id", "__text_a", "__text_b", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "group")


def join_components(docs: DataFrame, **parameters: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return join_groups(docs, **parameters).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of least
    doc_id, then text key. Rows without a doc_id cannot be named as another's
    copy, and rows without words are nobody's: both stay."""
    own = [docs[c] for c in docs.columns]
    keys = ["doc_id", "__text_a", "__text_b"]
    groups = join_groups(docs.select("doc_id", "text"))
    least = groups.filter("`group` is not null").groupBy("group").agg(F.min(F.struct(*keys)).alias("k"))
    least = least.select(F.col("k.doc_id").alias("__k0"), F.col("k.__text_a").alias("__k1"), F.col("k.__text_b").alias("__k2"))
    rows = docs.select(*own, *text_keys(docs), docs["doc_id"].cast("long").alias("__id"))
    alone = F.col("__id").isNull() | ~F.coalesce(F.col("text").rlike(f"[^{SPACE}]"), F.lit(False))
    same = (F.col("__id") == F.col("__k0")) & (F.col("__text_a") == F.col("__k1")) & (F.col("__text_b") == F.col("__k2"))
    chosen = rows.filter(~alone).join(least, same, "left_semi").dropDuplicates(["__id", *keys[1:]])
    return chosen.unionByName(rows.filter(alone)).select(*docs.columns)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return join_components(table(spark, sf_dir, "documents"))
