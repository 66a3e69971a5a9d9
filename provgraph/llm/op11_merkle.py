"""Merkle manifest of a table: a hash tree per language, one over their roots.

A leaf is the sha256 of a row's columns. The leaves of a tree stand in order of
doc_id; ``arity`` consecutive nodes become the hash of their digests, level by
level, until one is left. The trees' roots, in order of lang, become the root
in the same way.

The tree is climbed in Pregel's manner, as supersteps over RDDs. A vertex is
the subtree over ``arity ** levels`` consecutive nodes; vertices of a height
are the nodes under those of the next. Going up, children message their digest
to the parent; a parent that has all of its children hashes them and forwards
its own digest. Going down, each vertex receives the sibling digests above it,
adds those inside, and hands them to its children; at the lowest height each
leaf is folded with them and compared with the root.

Scale: a text is read once and reduced to its digest. Leaves are dealt by
ranges of (tree, doc_id, leaf, row), so that a tree of any size, and rows that
repeat any number of times, spread over tasks. One superstep rises ``levels``
levels: 10^10 leaves take four, and each moves a thousandth of the one before.
A vertex has ``arity ** levels`` children at most, whatever the data hold;
sibling paths travel to vertices, not to leaves. The vertices of each height
are written to the shared folder, so that a lost executor costs one superstep.
The driver learns only whether any tree goes on.

Defined results: a null column counts as ``-``; null langs are a tree of their
own, before all others; equal doc_ids stand in order of their leaves (null
doc_ids first), and rows that are equal throughout are leaves of their own,
one after the other; a lone leaf is its tree's root, a lone tree's root the
root, and the siblings of nothing hash as the empty text; rows without a doc_id
are not tampered with; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provgraph.llm.common import Scratch, table

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that become one, and levels that one superstep rises.
ARITY, LEVELS = 2, 10
#: Rows of which this divides the checksum are tampered with, to show that it is seen.
TAMPER = 7

VERTEX = "tree string, block long, n long, ids array<string>, digests array<string>, fakes array<string>, own string, rest long"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hash(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(**changed: Column) -> Column:
    """The sha256 of a row's columns; some may be given anew."""

    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, COLUMNS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, id, leaf, fake): fake is the leaf after tampering, null without."""
    more = F.col("n_chars").cast("decimal(37,0)") + F.lit(1)
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # null first
    rows = docs.select(*[docs[c] for c in COLUMNS])
    return rows.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf_of().alias("leaf"), F.when(tampered, leaf_of(n_chars=more)).alias("fake"))


def placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (tree, id, leaf, fake) with each row's place in its tree and
    the tree's number of rows, n."""
    kept = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
    order = [F.asc_nulls_first("id"), F.asc("leaf"), F.asc("row")]
    dealt = scratch.save(kept.repartitionByRange(F.asc("tree"), *order).withColumn("part", F.spark_partition_id()))
    # one row for each tree of a range
    counts, tree = dealt.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("k")), Window.partitionBy("tree")
    before = F.coalesce(F.sum("k").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("part", "tree", before.alias("before"), F.sum("k").over(tree).alias("n"))
    inside = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(counts, ["part", "tree"]).select("tree", "n", (F.col("before") + F.col("inside")).alias("place"), "id", "leaf", "fake")


def levels_of(digests: list[str], n: int, arity: int, levels: int) -> tuple[list[list[str]], int]:
    """The levels over ``digests``, a part of a level of ``n`` nodes, themselves
    first, and how many nodes the whole level has where they end."""
    found = [digests]
    while n > 1 and len(found) <= levels:
        below = found[-1]
        found.append([_hash(*below[i : i + arity]) for i in range(0, len(below), arity)])
        n = -(-n // arity)
    return found, n


def path_of(found: list[list[str]], place: int, arity: int) -> list[tuple[str, str]]:
    """For each level the siblings before and after, from ``place`` up."""
    path = []
    for level in found[:-1]:
        first = place - place % arity
        path.append(("".join(level[first:place]), "".join(level[place + 1 : first + arity])))
        place //= arity
    return path


def climb(rows: DataFrame, scratch: Scratch, arity: int, levels: int) -> list[DataFrame]:
    """The vertices (``VERTEX``) of each height, from placed rows."""
    spark, span = rows.sparkSession, arity**levels
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def messages(part: Iterator) -> Iterator:
        """Neighbours of one parent that a task holds go in one message."""
        key, n, held = None, 0, []
        for tree, count, place, name, digest, fake in part:
            to = (tree, place // span)
            if to != key:
                if held:
                    yield key, (n, held)
                key, n, held = to, count, []
            held.append((place, digest, name, fake))
        if held:
            yield key, (n, held)

    def complete(item: tuple) -> tuple:
        (tree, block), parts = item
        parts = list(parts)
        n = parts[0][0]
        children = sorted((x for _, held in parts for x in held), key=lambda x: x[0])
        if len(children) != min(span, n - block * span):
            raise ValueError(f"vertex {block} of tree {tree!r} lacks children")
        digests = [x[1] for x in children]
        found, rest = levels_of(digests, n, arity, levels)
        return tree, block, n, [x[2] for x in children], digests, [x[3] for x in children], found[-1][0], rest

    heights, going = [], rows.select("tree", "n", "place", F.col("id").cast("string"), "leaf", "fake")
    while True:
        done = going.rdd.mapPartitions(messages).groupByKey(tasks).map(complete)
        heights.append(scratch.save(spark.createDataFrame(done, VERTEX, verifySchema=False)))
        none = F.lit(None).cast("string")
        going = heights[-1].filter("rest > 1").select("tree", F.col("rest").alias("n"), F.col("block").alias("place"), none.alias("id"), F.col("own").alias("leaf"), none.alias("fake"))
        if going.isEmpty():
            return heights


def descend(heights: list[DataFrame], crowns: RDD, give: Callable, arity: int, levels: int) -> RDD:
    """What ``give(vertex, levels, path, facts)`` yields for each vertex of the
    lowest height. ``crowns`` holds ((tree, 0), (path, facts)) of each tree's
    root: the siblings above it."""
    span = arity**levels
    tasks = int(heights[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = None
    for height in range(len(heights) - 1, -1, -1):
        keyed = heights[height].rdd.map(lambda v: ((v.tree, v.block), v))
        # trees that end here start from their crown, others from their parents
        start = keyed.filter(lambda x: x[1].rest == 1).map(lambda x: (x[0], None)).join(crowns, tasks).mapValues(lambda x: x[1])
        got = start if sent is None else start.union(sent)

        def hand_on(item: tuple, last: bool = height == 0) -> Iterator:
            (tree, block), (vertex, (path, facts)) = item
            found, _ = levels_of(list(vertex.digests), vertex.n, arity, levels)
            if last:
                yield from give(vertex, found, path, facts)
            else:
                for place in range(len(found[0])):
                    yield (tree, block * span + place), (path_of(found, place, arity) + path, facts)

        sent = keyed.join(got, tasks).flatMap(hand_on)
    return sent


def manifest(docs: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """Leaf, roots, proof and check of every row; see the module."""
    spark = docs.sparkSession
    scratch, kept = Scratch(spark, "merkle"), Scratch(spark, "merkle-result")
    forest = climb(placed(leaves(docs), scratch), scratch, arity, levels)
    roots = forest[0].filter("rest = 1")
    for height in forest[1:]:
        roots = roots.unionByName(height.filter("rest = 1"))
    # the trees' roots are the leaves of the last tree, in order of their name
    roots = roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("own").alias("leaf"), F.lit(None).cast("string").alias("fake"))
    crown = climb(placed(roots, scratch), scratch, arity, levels)

    def to_trees(vertex, found, path, facts):
        for place, (tree, digest) in enumerate(zip(vertex.ids, found[0])):
            yield (tree, 0), (path_of(found, place, arity) + path, (digest, *facts))

    def to_leaves(vertex, found, path, facts):
        subroot, root = facts
        upper, known = "".join(a + b for a, b in path), {}
        for place, (name, leaf, fake) in enumerate(zip(vertex.ids, found[0], vertex.fakes)):
            inner = path_of(found, place, arity)
            node = fake or leaf
            for a, b in inner:
                node = _hash(a, node, b)
            if node not in known:  # untampered leaves of a vertex fold to the same node
                folded = node
                for a, b in path:
                    folded = _hash(a, folded, b)
                known[node] = folded
            proof = _hash("".join(a + b for a, b in inner), upper)
            yield None if name is None else int(name), leaf, subroot, root, proof, known[node], known[node] == root

    ends = crown[-1].rdd.filter(lambda v: v.rest == 1).map(lambda v: ((v.tree, 0), ([], (v.own,))))
    crowns = descend(crown, ends, to_trees, arity, levels)
    rows = descend(forest, crowns, to_leaves, arity, levels)
    out = kept.save(spark.createDataFrame(rows, RESULT, verifySchema=False))
    scratch.drop()
    return out


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of every document."""
    return manifest(table(spark, sf_dir, "documents"))
