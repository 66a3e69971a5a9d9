"""Best-fit packing with several permitted sequence lengths.

Documents longer than the largest permitted length are cut into pieces of that
length. Pieces are packed longest first, each into the open bin with the least
room that still holds it. Where none does, a bin is opened. Several opening
rules are tried: one for each permitted length, and one that takes the length
of least cost for what is still to be packed. At the end every bin is
downsized to the least permitted length that holds its contents, and the rule
whose bins then cost least is taken.

Scale: rows (id, piece, length), without texts, are counted if equal, and
dealt by hash into groups of about ``per_group`` pieces, counts over that in
parts; so a task holds a bounded number of small rows even if one id stands on
a third of them. Groups are independent, and each loses at most a few
part-filled bins, which downsizing shrinks. Bins are numbered by group, so that
a rerun of a lost task gives the same numbers. Lengths are saved first, so
that texts are read once.

Defined results: an item of length 0 or null is packed with length 0, in the
fullest bin; repeated ids are separate items, equal rows too; a null id is
packed like others; an empty table gives no row; other columns are not used.
An id column that is called like one of the result's is returned as ``id``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.common import Scratch, table, text_of, words

LENGTHS = (256, 512, 1024, 2048, 4096)
PER_GROUP = 4000


def cost(length: int, fixed: float = 32.0, square: float = 65_536.0) -> float:
    """Cost of one sequence: its tokens, a constant, and attention's square."""
    return fixed + length + length * length / square


def pack_once(sizes: list[int], lengths: tuple[int, ...], opening: int | None) -> tuple[list[int], list[int]]:
    """Best fit of sizes given in falling order.

    Returns each item's bin, and the bins' contents. ``opening`` is the least
    length of a new bin; None takes the least-cost one for what remains.
    """
    room: dict[int, list[int]] = {}  # free room -> bins
    mask, contents, bins, left = 0, [], [], sum(sizes)
    for size in sizes:
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            able = [c for c in lengths if c >= size]
            free = min(able, key=lambda c: (cost(c) / max(1, min(c, left)), c)) if opening is None else next((c for c in able if c >= opening), able[-1])
            b = len(contents)
            contents.append(0)
        contents[b] += size
        bins.append(b)
        left -= size
        room.setdefault(free - size, []).append(b)
        mask |= 1 << (free - size)
    return bins, contents


def pack(sizes: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, final length of its bin) of the least-cost rule."""
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order].tolist()
    steps = np.array(lengths)
    best = None
    for opening in (None, *lengths):
        bins, contents = pack_once(falling, lengths, opening)
        final = steps[np.searchsorted(steps, contents)]
        total = sum(map(cost, final.tolist()))
        if best is None or total < best[0]:
            best = total, bins, final
    out = np.empty(len(sizes), np.int64)
    out[order] = best[1]
    return out, best[2][out]


RESULT = "piece int, start long, length long, bin_id long, capacity long, offset long"


def pieces(items: DataFrame, id_column: str, length: str, most: int) -> DataFrame:
    """(__id, piece, start, length): items cut into pieces of at most ``most``."""
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    cut = items.select(F.col(id_column).alias("__id"), n.alias("__n")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("__n") / most) - 1, F.lit(0)).cast("int"))))
    start = F.col("piece").cast("long") * most
    return cut.select("__id", "piece", start.alias("start"), F.least(F.col("__n") - start, F.lit(most)).alias("length"))


def best_fit(items: DataFrame, id_column: str, length: str, lengths: tuple[int, ...] = LENGTHS, per_group: int = PER_GROUP) -> DataFrame:
    """One row for each piece: its bin, the bin's length, its place in it."""
    lengths = tuple(sorted(set(lengths)))
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    cut = Scratch(items.sparkSession, "pieces").save(pieces(items, id_column, length, lengths[-1]))
    n = cut.select(F.count(F.lit(1)).alias("n")).first().n
    groups = max(1, -(-n // per_group))
    cut = cut.groupBy("__id", "piece", "start", "length").agg(F.count(F.lit(1)).alias("copies"))
    # equal rows in parts of per_group
    cut = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / per_group).cast("int"))))
    cut = cut.withColumn("copies", F.least(F.col("copies") - F.col("part") * per_group, F.lit(per_group)))
    cut = cut.withColumn("grp", F.pmod(F.xxhash64("__id", "piece", "length", "part"), F.lit(groups)))
    id_name = "id" if id_column.lower() in ("piece", "start", "length", "bin_id", "capacity", "offset") else id_column

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("__id", "piece", "length", "part")]))
        rows = rows.take(np.repeat(np.arange(len(rows)), rows.column("copies").to_numpy()))
        sizes = rows.column("length").to_numpy()
        bins, final = pack(sizes, lengths)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(sizes))))
        columns = [rows.column(c).combine_chunks() for c in ("__id", "piece", "start", "length")]
        columns += [pa.array(x, pa.int64()) for x in (rows.column("grp").to_numpy() * (1 << 32) + bins, final, offset)]
        return pa.Table.from_arrays(columns, names=names)

    names = [id_name, "piece", "start", "length", "bin_id", "capacity", "offset"]
    return cut.groupBy("grp").applyInArrow(run, f"`{id_name}` {cut.schema['__id'].dataType.simpleString()}, {RESULT}")


def with_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n): words of each text, and one mark for its end."""
    return docs.select("doc_id", (F.size(words(text_of(docs))) + 1).cast("long").alias("n"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """The packing of all documents."""
    return best_fit(with_lengths(table(spark, sf_dir, "documents")), "doc_id", "n")
