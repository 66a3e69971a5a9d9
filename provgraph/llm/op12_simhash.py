"""SimHash near-duplicates: exact comparison of 64-bit fingerprints, by tiles.

A document's fingerprint has the bits that more than half of its three-word
shingles' hashes have. Fingerprints link at ``RADIUS`` or fewer differing bits,
and documents that links join, over any number of steps, are one component.

Two fingerprints within the radius have population counts that differ by no
more than the radius; this holds of any part of them, and the differences of
the parts add up. So tiles are made by the counts of all sixteen groups of four
bits, held in one word (a nibble a count), and a pair of tiles is compared only
if the counts differ by at most the radius in sum. Two tiles that differ by 2
both lie within 1 of a third (or of each other), so each fingerprint goes to
the 1 + 2 * 16 tiles within 1 of its own, and what meets in a tile is compared
there with numpy's exclusive-or and bit counts. A large tile is ordered by the
whole count and compared by blocks, and pairs of blocks whose counts lie
further apart than the radius are skipped. A tile of more than ``LARGE``
fingerprints is dealt to several tasks by pairs of its parts.

Scale: equal fingerprints are one from the start, so that exact copies cost one
aggregate, combined map-side. 33 messages of two numbers are shuffled for each
distinct fingerprint; there are 5^16 tiles, so that even 10^11 random
fingerprints meet few others. Tasks read their tiles in order and hold one at a
time. A tile gives one link a fingerprint, to the least of those that it is
joined with there, and never its pairs. Components are found by contraction of
links in the shared folder; nothing but counts of what is left comes to the
driver.

Defined results: null and empty texts, and such without words, have fingerprint
zero and link like any other; fewer than three words are one shingle; repeated
rows each give their row; equal texts are one component; the smallest doc_id of
a component leaves out null ones, and a component without any has null; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.common import Scratch, table
from provgraph.llm.components import connected_components
from provgraph.llm.hashing import slices, utf8, word_bounds

#: The tiles serve a radius of 2 at most.
SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints of a tile that one task compares, and those of a block.
LARGE, BLOCK = 8192, 1024

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.array([p], np.uint64) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start : start + length] for each pair, all at once."""
    held = np.concatenate((data, np.zeros(8, np.uint8)))
    # the eight bytes from each place on, as a number
    eight = np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))
    lane = lambda at: eight[at].astype(np.uint64)
    one = lambda acc, x: _turn(acc + x * P2, 31) * P1
    out, seed = np.full(len(starts), seed, np.uint64) + P5, np.uint64(seed)
    at, left = starts.copy(), lengths.copy()
    long = np.flatnonzero(lengths >= 32)
    if len(long):
        acc = [np.full(len(long), seed) + add for add in (P1 + P2, P2, P1 - P1, P1 - P1 - P1)]
        going = np.arange(len(long))
        while len(going):
            here = at[long[going]]
            for k in range(4):
                acc[k][going] = one(acc[k][going], lane(here + 8 * k))
            at[long[going]] += 32
            left[long[going]] -= 32
            going = going[left[long[going]] >= 32]
        total = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for a in acc:
            total = (total ^ one(np.zeros_like(a), a)) * P1 + P4
        out[long] = total
    out += lengths.astype(np.uint64)
    for _ in range(3):
        go = np.flatnonzero(left >= 8)
        out[go] = _turn(out[go] ^ one(np.zeros(len(go), np.uint64), lane(at[go])), 27) * P1 + P4
        at[go] += 8
        left[go] -= 8
    go = np.flatnonzero(left >= 4)
    out[go] = _turn(out[go] ^ (lane(at[go]) & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    at[go] += 4
    left[go] -= 4
    for _ in range(3):
        go = np.flatnonzero(left > 0)
        out[go] = _turn(out[go] ^ held[at[go]].astype(np.uint64) * P5, 11) * P1
        at[go] += 1
        left[go] -= 1
    out = (out ^ (out >> np.uint64(33))) * P2
    out = (out ^ (out >> np.uint64(29))) * P3
    return out ^ (out >> np.uint64(32))


def fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text."""
    data, offsets = utf8(column)
    starts, ends = word_bounds(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    # the words again, each followed by one space
    sizes = ends - starts
    to = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes + 1)))
    plain = np.full(to[-1], 32, np.uint8)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    solid = np.zeros(len(data) + 1, np.int8)
    solid[starts] = 1
    solid[ends] -= 1
    letters = data[np.cumsum(solid[:-1], dtype=np.int8).astype(bool)] if len(starts) else data[:0]
    capital = (letters >= 65) & (letters <= 90)
    plain[inside] = letters + capital.astype(np.uint8) * np.uint8(32)
    counts = np.diff(bounds)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    out = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    row = np.repeat(np.arange(len(counts)), n)
    first = bounds[:-1][row] + np.arange(out[-1]) - out[:-1][row]
    last = first + np.minimum(SHINGLE, counts)[row]
    found = np.zeros(len(counts), np.uint64)
    if not len(first):
        return found
    h = xxh64(plain, to[first], to[last] - 1 - to[first])
    some = np.flatnonzero(n)
    for bit in range(64):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), out[:-1][some])
        found[some] |= (2 * ones > n[some]).astype(np.uint64) << np.uint64(bit)
    return found


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, f) of every row, f as a signed number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                f = fingerprints(part.column(1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(f)], ["doc_id", "f"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, f long")


def tiles_of(f: np.ndarray) -> np.ndarray:
    """Counts of the sixteen groups of four bits, a nibble each."""
    pairs = f - ((f >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (pairs & np.uint64(0x3333333333333333)) + ((pairs >> np.uint64(2)) & np.uint64(0x3333333333333333))


def messages(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tile, fingerprint): its own tile and those within 1 of it."""
    own = tiles_of(f)
    tiles, which = [own], [f]
    for k in range(16):
        count, step = (own >> np.uint64(4 * k)) & np.uint64(15), np.uint64(1 << 4 * k)
        for fits, there in ((count < 4, own + step), (count > 0, own - step)):
            tiles.append(there[fits])
            which.append(f[fits])
    return np.concatenate(tiles), np.concatenate(which)


def joined(f: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct fingerprints: the place of the first that each is joined
    with, over links among them.

    In order of population counts, block by block; pairs of blocks with counts
    further apart than the radius are skipped.
    """
    order = np.argsort(np.bitwise_count(f), kind="stable")
    g = f[order]
    counts, label = np.bitwise_count(g).astype(int), np.arange(len(g))
    cuts = range(0, len(g), BLOCK)
    for a in cuts:
        block, top = g[a : a + BLOCK, None], counts[min(a + BLOCK, len(g)) - 1]
        for b in cuts[a // BLOCK :]:
            if counts[b] - top > radius:
                break
            x, y = np.nonzero(np.bitwise_count(block ^ g[None, b : b + BLOCK]) <= radius)
            keep = x + a < y + b
            if keep.any():
                x, y = x[keep] + a, y[keep] + b
                while (label[x] != label[y]).any():  # labels are always roots here
                    low = np.minimum(label[x], label[y])
                    np.minimum.at(label, label[x], low)
                    np.minimum.at(label, label[y], low)
                    while (label != label[label]).any():
                        label = label[label]
    out = np.empty(len(f), np.int64)
    out[order] = order[label]
    return out


LINKS = "a long, b long"
#: A tile's fingerprints that are too many for a task have a and the tile.
FOUND = "a long, b long, tile long"


def compare(batches: Iterator[pa.RecordBatch], radius: int, large: int | None) -> Iterator[pa.RecordBatch]:
    """Links of sorted (tile, f) rows; tiles of more than ``large`` come out
    again as they are, to be dealt anew."""

    def give(a, b, tile=None):
        tile = pa.nulls(len(a), pa.int64()) if tile is None else pa.array(np.full(len(a), tile, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), tile], ["a", "b", "tile"])

    def one(f):
        f = np.unique(f)
        to = joined(f, radius)
        linked = to != np.arange(len(f))
        return give(f[linked], f[to[linked]])

    tail_tile, tail, over = None, [], False  # the tile that the last batch broke off in
    for batch in batches:
        tile, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(tile):
            continue
        cuts = np.concatenate(([0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]))
        sizes, first = np.diff(cuts), 0
        if tail_tile is not None and tile[0] == tail_tile:
            tail.append(f[: cuts[1]])
            first = 1
        if len(sizes) > first or tail_tile is None:
            if tail and sum(map(len, tail)) > 1 and not over:
                yield one(np.concatenate(tail))
            elif over:
                for part in tail:
                    yield give(part, part, tail_tile)
            # pairs of two are most: all at once
            last = len(sizes) - 1
            two = np.flatnonzero(sizes[first:last] == 2) + first
            a, b = f[cuts[two]], f[cuts[two] + 1]
            near = np.bitwise_count(a ^ b) <= radius
            if near.any():
                yield give(a[near], b[near])
            for k in np.flatnonzero(sizes[first:last] > 2) + first:
                part = f[cuts[k] : cuts[k + 1]]
                if large and len(part) > large:
                    yield give(part, part, tile[cuts[k]])
                else:
                    yield one(part)
            tail_tile, tail, over = tile[cuts[last]], [f[cuts[last] :]], False
        if large and sum(map(len, tail)) > large:
            for part in tail:
                yield give(part, part, tail_tile)
            tail, over = [], True
    if over:
        for part in tail:
            yield give(part, part, tail_tile)
    elif sum(map(len, tail)) > 1:
        yield one(np.concatenate(tail))


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """(a, b): links that join what is to be joined of the fingerprints f."""

    def send(batches):
        for batch in batches:
            tile, f = messages(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(tile.view(np.int64)), pa.array(f.view(np.int64))], ["tile", "f"])

    sent = distinct.mapInArrow(send, "tile long, f long")
    found = scratch.save(sent.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda b: compare(b, radius, large), FOUND))
    rest = found.filter("tile is not null").select("tile", F.col("a").alias("f"))
    # a tile of k parts: each pair of parts is a tile of its own
    parts = rest.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) * 2 / large).cast("int").alias("k"))
    dealt = rest.join(parts, "tile").withColumn("p", F.pmod(F.xxhash64("f"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select(F.xxhash64("tile", F.least("p", "q"), F.greatest("p", "q")).alias("tile"), "f")
    more = dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda b: compare(b, radius, None), FOUND)
    return found.filter("tile is null").select("a", "b").union(more.select("a", "b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius from 0 to {RADIUS}")
    scratch, kept = Scratch(docs.sparkSession, "simhash"), Scratch(docs.sparkSession, "simhash-result")
    rows = kept.save(fingerprinted(docs))
    classes = scratch.save(rows.groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")))
    labels = connected_components(links(classes.select("f"), scratch, radius, large), scratch)
    named = scratch.save(classes.join(labels, F.col("f") == F.col("v"), "left").select("f", "doc_id", "n", F.coalesce("c", "f").alias("c")))
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = kept.save(named.join(least, "c").select(F.col("f").alias("g"), "n", "component_id"))
    scratch.drop()
    # The rows of a fingerprint that has more than a share of them are dealt to
    # several tasks; there are at most as many such as there are shares.
    shares = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, (named.agg(F.sum("n")).first()[0] or 0) // shares)
    parts = F.ceil(F.col("n") / share).cast("int")
    wide = named.filter(F.col("n") > share).select(F.col("g").alias("w"), parts.alias("k"))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("k")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(wide), F.col("f") == F.col("w"), "left").select("doc_id", "f", salt.alias("s"))
    named = named.select("g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "component_id")
    out = dealt.join(named, (F.col("f") == F.col("g")) & (F.col("s") == F.col("part")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
