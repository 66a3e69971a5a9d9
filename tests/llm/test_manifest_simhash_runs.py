"""op11, op12 and op13 as registered, on odd rows, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from provgraph.llm import op11_merkle as eleven
from provgraph.llm import op12_simhash as twelve
from provgraph.llm import op13_runs as thirteen
from provgraph.llm.common import Scratch
from provgraph.llm.components import connected_components
from provgraph.llm.queries import QUERIES

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    words = ["ka", "Lo", "mi", "nÜ", "漢字", "pe"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 3)) for _ in range(n))
    rows = [(i, prose(rng.randint(1, 120)), rng.choice(["en", "fr", "é", "", None]), rng.choice(["hot", None, "b:1"]), rng.choice([None, i * 10])) for i in range(240)]
    rows += [rows[3]] * 30 + [(3, rows[3][1], "en", "hot", 5), (3, rows[4][1], "en", "hot", 5), (None, rows[5][1], "en", None, 3), (None, rows[5][1], "en", None, 3), (None, None, None, None, None)]
    rows += [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (502, " \n\t ", "xx", "s", 3), (503, "x" * 30_000, "en", "s", 1), (504, prose(20_000), "en", "s", 1), (505, "a " * 6_000 + "b c " * 3_000, "fr", "s", 1)]
    rows += [(600 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))), "en", "s", 1) for i in range(120)]
    # texts of which one word was changed, so that fingerprints are near
    rows += [(800 + i, " ".join(rows[10][1].split()[: 5 + i % 60]), "en", "s", 1) for i in range(60)]
    folder = tmp_path_factory.mktemp("new")
    extra = [F.lit(7).alias(c) for c in ("tree", "leaf", "place", "n", "f", "c", "check", "length", "part")]
    spark.createDataFrame(rows, FIELDS).select("*", *extra).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, arity=2):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(tree, place, arity=2):
    out = []
    for level in tree[:-1]:
        first = place // arity * arity
        out.append(("".join(level[first:place]), "".join(level[place + 1 : first + arity])))
        place //= arity
    return out


def manifest(rows, arity=2):
    trees = collections.defaultdict(list)
    for row in rows:
        fake = leaf(row, 1) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 else None
        trees[row[2]].append((row[0], leaf(row), fake))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for held in trees.values():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    inner = {k: levels([x[1] for x in trees[k]], arity) for k in langs}
    top = levels([inner[k][-1][0] for k in langs], arity)
    root, out = top[-1][0], []
    for i, k in enumerate(langs):
        for j, (doc_id, own, fake) in enumerate(trees[k]):
            path, node = siblings(inner[k], j, arity) + siblings(top, i, arity), fake or own
            for a, b in path:
                node = H(a, node, b)
            out.append((doc_id, own, inner[k][-1][0], root, H("".join(a + b for a, b in path)), node, node == root))
    return collections.Counter(out)


def test_manifest(spark, folder):
    path, rows = folder
    got = [tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, path).collect()]
    assert collections.Counter(got) == manifest(rows)
    tampered = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None}
    assert {r[0] for r in got if not r[-1]} == tampered and tampered


@pytest.mark.parametrize("arity,step", [(2, 3), (16, 1)])
def test_manifest_of_several_heights(spark, folder, arity, step):
    """Vertices of few levels, so that several supersteps are needed."""
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert collections.Counter(tuple(r) for r in eleven.manifest(docs, arity, step).collect()) == manifest(rows, arity)


def test_manifest_of_one_row(spark):
    docs = spark.createDataFrame([(7, "a", "en", "s", 1)], FIELDS)
    (row,) = eleven.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == leaf((7, "a", "en", "s", 1)) and row.proof_sha256 == H("")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius=2):
    """For each distinct value the least of its component."""
    label = {v: v for v in values}
    f = np.array(sorted(label), np.uint64)
    x, y = np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= radius)
    links = [(int(f[a]), int(f[b])) for a, b in zip(x, y) if a < b]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label, len(links)


def test_simhash(spark, folder):
    path, rows = folder
    prints = [fingerprint(r[1]) for r in rows]
    label, links = groups(prints)
    least = {}
    for row, f in zip(rows, prints):
        if row[0] is not None:
            least[label[f]] = min(row[0], least.get(label[f], row[0]))
    want = collections.Counter((r[0], f"{f:016x}", least.get(label[f])) for r, f in zip(rows, prints))
    assert collections.Counter(tuple(r) for r in QUERIES["op12_simhash_dedup"](spark, path).collect()) == want and links


def test_xxh64():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts, lengths = rng.integers(0, 2700, 2000), rng.integers(0, 300, 2000)
    want = [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), seed=42) for s, n in zip(starts, lengths)]
    assert twelve.xxh64(data, starts, lengths).tolist() == want


@pytest.mark.parametrize("large", [40, 8192])
def test_simhash_links_with_large_tiles(spark, large):
    """Fingerprints about a few centres; tiles are split, or not."""
    rng, values = random.Random(5), {0}
    for centre in [rng.getrandbits(64) for _ in range(3)] + [0]:
        for _ in range(300):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    label, _ = groups(values)
    f = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    scratch = Scratch(spark, "test")
    found = connected_components(twelve.links(spark.createDataFrame([(x,) for x in f], "f long"), scratch, large=large), scratch)
    got = {r.v: r.c for r in found.collect()}
    as_sets = lambda of: {frozenset(g) for g in of.values()}
    mine, theirs = collections.defaultdict(set), collections.defaultdict(set)
    for v in values:
        signed = v - (1 << 64) if v >> 63 else v
        mine[got.get(signed, signed)].add(v)
        theirs[label[v]].add(v)
    assert as_sets(mine) == as_sets(theirs)


def runs(words):
    n, x, out = len(words), np.unique(np.array(words), return_inverse=True)[1] if words else np.zeros(0, int), []
    for q in range(1, n // 4 + 1):
        edges = np.diff(np.concatenate(([0], (x[q:] == x[: n - q]).astype(int), [0])))
        for i, j in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            length = int(j - i + q)
            if length >= max(6, 4 * q) and not any((x[i : i + length - p] == x[i + p : i + length]).all() for p in range(1, q)):
                out.append((int(i), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs(spark, folder):
    path, rows = folder
    want, longer = collections.Counter(), 0
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = runs(words)
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        longer += len(found) > 1
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        want[doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, H(listed), H(kept)] += 1
    got = collections.Counter(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, path).collect())
    assert got == want and longer


def test_runs_of_small_alphabets():
    """All repetitions of two periods or more, not only long ones."""
    rng = random.Random(8)
    for _ in range(300):
        docs = [[rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 30))] for _ in range(3)]
        bounds = np.cumsum([0] + [len(d) for d in docs])
        keys = np.array([(i << 32) + v for i, d in enumerate(docs) for v in d], np.int64)
        x = np.unique(keys, return_inverse=True)[1]
        want = set()
        for at, d in zip(bounds, docs):
            for q in range(1, len(d) // 2 + 1):
                i = 0
                while i + q < len(d):
                    j = i
                    while j + q < len(d) and d[j] == d[j + q]:
                        j += 1
                    n = j - i + q
                    if n >= 2 * q and not any(d[i : i + n - p] == d[i + p : i + n] for p in range(1, q)):
                        want.add((int(at) + i, n, q))
                    i = j + 1
        assert set(zip(*[a.tolist() for a in thirteen.runs_of(x, bounds)])) == want


def test_empty_batch():
    assert thirteen.find_runs(pa.array([], pa.string()), []) == [] and not len(twelve.fingerprints(pa.array([], pa.string())))
