"""Corpus operators against brute force, and on odd rows."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provgraph.llm import common
from provgraph.llm import op1_classifier as one
from provgraph.llm import op2_sharding as two
from provgraph.llm import op3_pii as three
from provgraph.llm import op4_rules as four
from provgraph.llm import op5_jaccard as five
from provgraph.llm import op6_packing as six
from provgraph.llm import op7_links as seven
from provgraph.llm import op8_tokens as eight
from provgraph.llm import op9_decontaminate as nine
from provgraph.llm import op10_spans as ten
from provgraph.llm.common import Scratch

RNG = random.Random(3)
WORDS = ["w%d" % i for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(RNG.choices(WORDS, k=20_000))


def prose(n=80):
    return " ".join(RNG.choice(WORDS) + ("." if i % 9 == 8 else "") for i in range(n)) + "."


def changed(text, every):
    return " ".join("new%d" % i if i % every == 5 else w for i, w in enumerate(text.split()))


ROWS = [(i, prose()) for i in range(20)]
ROWS += [(20, ROWS[3][1]), (21, changed(ROWS[4][1], 60)), (22, None), (23, ""), (24, "  \n\t "), (25, "one two"), (26, "One  two"), (27, LONG), (28, LONG + " end"), (5, ROWS[5][1]), (None, ROWS[6][1]), (29, "a b c d e f g h i j"), (30, "a b c d e f g h i k"), (31, ("x y z " * 40).strip())]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, None if d == 1 else "en", None if d == 2 else "s", None if t is None else len(t)) for d, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_classifier(spark, docs, empty):
    good, bad = [prose().encode() for _ in range(60)], [prose().upper().replace(" ", "!! ").encode() for _ in range(60)]
    model = one.fit(good, bad)
    rows = spark.createDataFrame([(1, prose(), 9.0), (2, prose().upper().replace(" ", "!! "), 9.0), (3, "", 9.0), (4, None, 9.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in one.classify(rows, model).collect()}
    assert got[1].score > 0.9 and got[1].predicted == 1 and got[2].score < 0.1 and got[3].score == got[4].score == 0.0
    assert one.classify(docs, model).count() == len(ROWS) and one.classify(empty, model).count() == 0
    assert one.fit([], []).prior == 0.5 and one.score_texts(one.fit(good, []), pa.array(["x"]))[0] == 1.0
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert all(not one.held_out(r.doc_id) for r in one.training_rows(labels).collect())
    long = spark.createDataFrame([(i, f"{i} " * 9000) for i in range(40)], "doc_id long, text string")
    texts = one.sample(long, labels)
    assert all(len(x) > 10 and all(1000 < len(t) <= one.MAX_BYTES for t in x) for x in texts)
    texts = one.sample(docs, labels, max_docs=3)
    assert len(texts[0]) <= 3 and len(texts[1]) <= 3


def test_sharding(spark, docs, empty):
    names = ["a", "b", "c"]
    owner = two.fill(names, 101)
    share = collections.Counter(owner)
    assert max(share.values()) - min(share.values()) <= 1
    heavy = collections.Counter(two.fill(names, 101, {"a": 3}))
    assert heavy[0] > 1.8 * heavy[1]
    more = two.fill([*names, "d"], 1009)
    before = two.fill(names, 1009)
    assert sum(x != y for x, y in zip(before, more)) < 0.45 * 1009
    clash = docs.withColumn("slot", F.lit("old"))
    placed = two.place(clash, "doc_id", names, 101)
    assert placed.count() == len(ROWS) and dict(placed.dtypes)["slot"] == "int"
    assert placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).filter("n != 1").isEmpty()
    assert two.place(empty, "doc_id", names, 101).isEmpty()
    with pytest.raises(ValueError):
        two.fill(names, 100)


HIDDEN = ["john.doe [at] example [dot] com", "jane at mail dot example dot org", "plus one four one five five five five one two three four", "192 dot 168 dot 1 dot 10", "jоhn＠exаmple．com", "four one one one one one one one one one one one one one one one"]


def test_pii_hidden_and_plain():
    for t in HIDDEN:
        text = f"see {t} now"
        spans = three.find_spans(text)
        assert [text[s:e] for _, s, e, base in spans if not base] == [t], t
    text = "a.b@c.co, 1.2.3.4, +1 (456) 555-1234, 999.1.1.1"
    assert [(k, text[s:e]) for k, s, e, _ in three.find_spans(text)] == [("email", "a.b@c.co"), ("ip", "1.2.3.4"), ("phone", "+1 (456) 555-1234")]
    assert three.find_spans("meet at the dot on one two three") == []
    assert three.mask("x a@b.co y") == "x [EMAIL] y" and three.mask(None) is None
    assert len(three.find_spans("1" * 200_000 + " a" * 50_000)) == 0


def test_pii_base_is_the_plain_rule(docs, empty):
    alphabet = "a1.@+ -()9 5\n"
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    for _ in range(4000):
        text = "".join(RNG.choices(alphabet, k=60))
        plain = three.detect_plain(text)
        for kind, pattern in kinds.items():
            assert plain[kind] == [m.span() for m in re.finditer(pattern, text) if ok(kind, m.group())], text
    assert three.redact(docs).count() == len(ROWS) and three.detect(empty).isEmpty()
    assert three.detect(docs.withColumn("spans", F.lit(1))).filter("size(spans) > 0").isEmpty()


def test_rules(spark, docs, empty):
    odd = spark.createDataFrame([(1, "a b a b a b\nx\nx\n \nx #$", 0), (2, None, 0), (3, LONG, 0), (4, ("p q r s " * 300), 0), (5, " ".join(WORDS[:60]), 0), (6, " ".join(WORDS[:100] * 2) + " end", 0), (60, " ".join([f"w{i}" for i in range(400)] * 2 + ["x"] + [f"v{i}" for i in range(90)] * 3), 0), (7, " ".join([*WORDS[:90], "x", *WORDS[:90], *WORDS[20:110]]), 0)], "doc_id long, text string, kept int")
    judged = {r.doc_id: r for r in four.quality_rules(odd, [0.0] * (1 << 10)).collect()}
    for r in odd.collect():
        w = split(r.text)
        n = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if split(x)]
        g = judged[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and g.kept == (not g.base_failed)
    labels = spark.createDataFrame([(i, 1) for i in range(15)], "doc_id long, quality int")
    weights = four.ngram_weights(docs, labels, bits=10)
    assert len(weights) == 1024 and any(weights)
    assert not any(four.ngram_weights(docs, labels.filter("false"), bits=10)) and not any(four.ngram_weights(empty, labels, bits=10))
    assert four.quality_rules(docs, weights).count() == len(ROWS) and four.quality_rules(empty, weights).isEmpty()


def test_rules_count_every_trusted_document(spark):
    # with every document trusted the two multinomials are the same
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    labels = many.select("doc_id", F.lit(1).alias("quality"))
    assert not any(four.ngram_weights(many, labels, bits=10))
    # a label that repeats counts its document once; rows without an id are raw text
    odd = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "x"), (None, None)], "doc_id long, text string")
    twice = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, 0)], "doc_id long, quality int")
    got = four.ngram_weights(odd, twice, bits=4)
    of = {t: spark.range(1).select(four._bucket(4, F.xxhash64(F.lit(t))).alias("b")).first().b for t in "xy"}
    assert of["x"] != of["y"]
    for t, raw, target in (("x", 3, 2), ("y", 1, 0)):
        assert abs(got[of[t]] - (np.log((target + 1) / (2 + 16)) - np.log((raw + 1) / (4 + 16)))) < 1e-12


def components_by_force(rows):
    sets = {}
    for d, t in rows:
        w = [x for x in split(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))]
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    of = {d: d for d in sets}
    ids = sorted(sets)
    while True:
        before = dict(of)
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    of[a] = of[b] = min(of[a], of[b])
        if of == before:
            return {d: (len(sets[d]), of[d]) for d in ids}


def test_jaccard(spark, docs, empty):
    rows = [r for r in ROWS if r[0] is not None]
    base = prose(120)
    rows += [(100 + i, changed(base, 25 + i)) for i in range(8)] + [(200 + i, " ".join(f"q{j}" for j in range(i, i + 14))) for i in range(8)]
    frame = spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string").withColumn("c", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in five.join_components(frame).collect()}
    assert got.pop(None) == (1, None)
    assert got == components_by_force(rows)
    # the last round alone, without leaders or the order of frequent shingles
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in five.join_components(frame, rank_bits=9, rounds=0, map_bits=9).filter("doc_id is not null").collect()} == got
    assert five.join_components(empty).isEmpty()


def test_light_sets_need_no_check():
    for n in range(1, 12):
        for m in five.partner_sizes(n):
            c = five.least_overlap(n, m)
            assert 100 * c >= 80 * (n + m - c) and (c == 0 or 100 * (c - 1) < 80 * (n + m - c + 1))
    assert five.boundary({5: 10, 12: 10}, 1.0) < 12 <= five.boundary({5: 10, 12: 10}, 1e6)


def test_packing(spark, docs, empty):
    sizes = np.array([RNG.randint(0, 64) for _ in range(300)])
    bins, final = six.pack(sizes, (16, 32, 64))
    for b in set(bins):
        total = sizes[bins == b].sum()
        assert total <= final[bins == b][0] and not any(total <= c < final[bins == b][0] for c in (16, 32))
    rows = six.best_fit(six.with_lengths(docs), "doc_id", "n", (64, 256), per_group=7)
    r = rows.toPandas()
    assert r["length"].sum() == sum(len(split(t)) + 1 for _, t in ROWS)
    assert (r.groupby("bin_id")["length"].sum() <= r.groupby("bin_id")["capacity"].first()).all()
    assert (r["offset"] + r["length"] <= r["capacity"]).all()
    assert six.best_fit(six.with_lengths(empty), "doc_id", "n").isEmpty()
    with pytest.raises(ValueError):
        six.best_fit(six.with_lengths(docs), "doc_id", "n", ())


def test_urls(spark):
    links = '<a href="https://{}/x">x</a>'
    pages = [
        (1, "http://A.Good.org/p?q", links.format("friend.net")), (2, "http://bad.com/de/x", None), (3, "http://farm.net/", links.format("bad.com")), (4, "http://friend.net", ""), (5, None, None),
        (6, "no url", ""), (7, "http://x.example.org/es/1", ""), (8, "http://example.org/en/12#t", ""), (9, "http://other.net/?a", ""), (9, "http://other.net/?a", ""), (10, "http://notorg/", ""),
    ]
    got = {r.page_id: r for r in seven.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rounds=3).collect()}
    assert {k: (v.rule, v.verdict) for k, v in got.items()} == {
        1: ("org/", "allow"), 2: ("com/de/", "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"),
        7: ("example.org/es/", "block"), 8: ("example.org/en/1", "block"), 9: (None, "allow"), 10: (None, "allow"),
    }
    assert (got[1].host, got[1].path, got[5].host, got[8].path) == ("a.good.org", "/p", "", "/en/12")
    assert got[4].trust > 0 and got[3].distrust > 0
    assert seven.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), rounds=1).isEmpty()


def test_urls_verdict_by_one_link(spark):
    """A host without a rule is blocked for the host it links to alone."""
    mail = "<p>write to desk@bad.com</p>"
    pages = [(1, "http://bad.com/de/x", None), (2, "http://farm.net/", mail), (3, "http://sub.good.org/", "<p>see &copy; pal.net</p>"), (4, "http://pal.net/", ""), (5, "http://a.shop.co.uk/", ""), (6, "http://b.other.co.uk/", "x" * 200_000 + mail), (7, "http://in.bad.com/", None)]
    frame = spark.createDataFrame([(*p, 1.0, "t", "u") for p in pages], "page_id long, url string, html string, trust double, kind string, src string")
    got = {r.page_id: r for r in seven.judge_urls(frame).collect()}
    assert {k: v.verdict for k, v in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block"}
    assert {k: v.by for k, v in got.items()} == {1: "rule", 2: "links", 3: "rule", 4: "links", 5: "none", 6: "links", 7: "domain"}
    assert (got[2].links_out, got[1].links_in, got[4].links_in) == (1, 2, 1)
    alone = {r.page_id: (r.verdict, r.by) for r in seven.judge_urls(frame, inherit=False).collect()}
    assert alone[2] == alone[6] == ("block", "links") and alone[7] == ("allow", "none")
    hosts = frame.select("*", seven.host_and_path(F.col("url"))[0].alias("host"))
    edges = seven.named_hosts(hosts)
    found = {(r.src, r.dst): r.n for r in edges.union(seven.domain_edges(hosts)).collect()}
    assert found["farm.net", "bad.com"] == 1 and found["in.bad.com", "bad.com"] == 1 == found["bad.com", "in.bad.com"] and found["a.shop.co.uk", "shop.co.uk"] == 1
    assert not any("co.uk" == x for e in found for x in e) and ("pal.net", "net") not in found
    cut = edges.filter("not (src = 'farm.net')")
    assert {r.page_id: r.verdict for r in seven.judge_urls(frame, edges=cut).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block"}


def test_urls_rank_goes_back_to_the_seeds(spark):
    """Against personalised PageRank by matrices, with hosts without links."""
    rng = np.random.default_rng(6)
    n, damping = 12, 0.85
    links = [(i, int(j)) for i in range(8) for j in rng.choice(n, 3, replace=False) if i != j]
    seeds = [0, 5]
    move = np.zeros((n, n))
    for i, j in links:
        move[i, j] += 1
    start = np.zeros(n)
    start[seeds] = 0.5
    for i in range(n):
        move[i] = move[i] / move[i].sum() if move[i].sum() else start
    want = np.linalg.solve(np.eye(n) - damping * move.T, (1 - damping) * start)
    edges = spark.createDataFrame([("t", f"h{i}", f"h{j}", 1) for i, j in links], "kind string, src string, dst string, n long")
    got = {r.host: r["rank"] for r in seven.propagate(edges, spark.createDataFrame([("t", f"h{i}") for i in seeds], "kind string, host string"), Scratch(spark, "t")).collect()}
    assert all(abs(got.get(f"h{i}", 0.0) - want[i]) < 1e-4 for i in range(n)) and abs(sum(got.values()) - 1) < 1e-9


def test_urls_of_far_and_faint_hosts(spark):
    link = lambda to: f'<a href="https://{to}/x">x</a>'
    chain = ["bad.com", *(f"far{i}.net" for i in range(14))]
    pages = [(0, "http://bad.com/de/x", None), *((i, f"http://{b}/", link(a)) for i, (a, b) in enumerate(zip(chain, chain[1:]), 1))]
    # a thousand hosts link to the blocked one, as many to one of those, and so on
    top = "bad.com"
    for level in "abcd":
        pages += [(1000, f"http://{level}{i}.net/", link(top)) for i in range(1000)]
        top = f"{level}0.net"
    # a ring of hosts that nobody blocks, and one that links into it
    pages += [(2000, "http://r0.net/", link("r1.net")), (2000, "http://r1.net/", link("r0.net")), (2000, "http://r2.net/", link("r0.net"))]
    got = seven.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.host for r in got if r.verdict == "allow"} == {"r0.net", "r1.net", "r2.net"}
    assert 0 < min(r.distrust for r in got if r.host.startswith("d")) < 1e-10


def test_urls_run_until_ranks_are_final(spark):
    edges = spark.createDataFrame([("t", "a", "b", 1), ("t", "b", "a", 1)], "kind string, src string, dst string, n long")
    got = {r.host: r["rank"] for r in seven.propagate(edges, spark.createDataFrame([("t", "a")], "kind string, host string"), Scratch(spark, "t"), damping=0.5).collect()}
    assert abs(got["a"] - 2 / 3) < 1e-3 and abs(got["b"] - 1 / 3) < 1e-3


def test_ledger(spark, tmp_path, docs):
    ledger = eight.TokenLedger(spark, tmp_path.as_uri())
    batch = lambda rows: spark.createDataFrame(rows, eight.CHANGES)
    totals = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals().collect()}
    assert totals() == {}
    first = batch([("insert", 1, "s", "en", "v", 10, 50, 0), ("insert", 2, None, "en", "v", 5, 20, 0), ("insert", None, "s", "en", "v", 99, 99, 0), ("insert", 3, "s", "en", "v", None, None, 0), ("insert", 4, "s", "fr", "v", 1, 1, 0), ("insert", 4, "s", "fr", "v", 2, 2, 1)])
    assert ledger.commit(1, first) and not ledger.commit(1, first)
    assert totals() == {("s", "en", "v"): (2, 10, 50), (None, "en", "v"): (1, 5, 20), ("s", "fr", "v"): (1, 2, 2)}
    assert ledger.commit(2, batch([("revise", 1, "t", "en", "v", 7, 40, 0), ("delete", 2, None, None, "v", None, None, 0), ("delete", 77, "s", "en", "v", 1, 1, 0)]))
    assert totals() == {("s", "en", "v"): (1, 0, 0), ("t", "en", "v"): (1, 7, 40), ("s", "fr", "v"): (1, 2, 2)}
    with pytest.raises(ValueError):
        ledger.commit(0, first)


def test_token_counts(spark, docs):
    import base64

    import tiktoken

    held = open(f"{eight.TOKENIZERS}/{eight.VOCABULARY}.tiktoken", "rb")
    own = tiktoken.Encoding("t", pat_str=eight.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, held)}, special_tokens={})
    got = eight.count_tokens(docs.select("doc_id", "text", F.col("text").alias("t2")), ["t2"]).collect()
    assert all(r.t2 == (None if r.text is None else len(own.encode_ordinary(r.text))) for r in got) and len(got) == len(ROWS)


def test_decontamination(spark, docs, empty):
    items = [(i, prose(30 + i)) for i in range(12)] + [(50, None), (51, ""), (52, "w1 w2 w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = " ".join(w if k % 6 else "other" for k, w in enumerate(items[2][1].split()))
    planted = [(500, prose() + "\n" + items[0][1] + " " + prose()), (501, items[1][1].upper()), (502, prose() + " " + near + " " + prose()), (503, LONG + " " + items[3][1])]
    frame = docs.unionByName(spark.createDataFrame([(*p, "en", "s", 1) for p in planted], DOCS)).withColumn("cosine", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in nine.find_matches(frame, bench).collect()}
    assert got == {(500, 0), (501, 1), (502, 2), (503, 3)}
    kept = nine.decontaminate(frame, bench)
    assert kept.columns == frame.columns and kept.count() == len(ROWS) and kept.filter("doc_id >= 500").isEmpty()
    assert nine.find_matches(empty, bench).isEmpty() and nine.find_matches(docs, bench.filter("false")).isEmpty()
    assert nine.lcs([1, 2, 3, 4], [9, 1, 3, 2, 4]) == 3


def test_decontamination_finds_long_items(spark):
    few = lambda n: " ".join(f"v{RNG.randrange(9000)}" for _ in range(n))
    items = [(i, few(n)) for i, n in enumerate((60, 100, 150, 200, 300, 400, 500, 600))]
    rows = [(i, few(400)) for i in range(300)]
    for i, t in items:
        rows.append((1000 + i, few(70) + " " + t + " " + few(90)))
        rows.append((2000 + i, few(31) + " " + " ".join(w if RNG.random() < 0.85 else "other" for w in t.split()) + " " + few(50)))
        rows.append((3000 + i, few(50) + " " + " ".join(t.split()[: len(t.split()) // 3])))
    want = set()
    for d, t in rows:
        for i, x in items:
            share = nine.lcs(x.split(), t.split()) / len(x.split())
            want |= {(d, i)} if share >= nine.VERBATIM else set()
    got = {(r.doc_id, r.item_id) for r in nine.find_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 12 and want <= got and not any(d < 1000 or d >= 3000 for d, _ in got)


def test_decontamination_fits_in_bounded_memory():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 25, 10_000)  # one batch of passages
    at, bounds = rng.integers(0, 3000, n.sum()).astype(np.int32), np.concatenate(([0], np.cumsum(n))) + 7
    weights, q = rng.random(3000).astype(np.float32), rng.standard_normal((3000, 264)).astype(np.float32)
    out = np.zeros((3000, 264))
    tracemalloc.start()
    nine.add_products(out, at, bounds, weights, q)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x = np.zeros((10_000, 3000))
    np.add.at(x, (np.repeat(np.arange(10_000), n), at), weights[at])
    length = np.sqrt(np.bincount(np.repeat(np.arange(10_000), n), weights[at] ** 2, 10_000))
    x /= np.maximum(length, 1e-9)[:, None]
    assert np.abs(x.T @ (x @ q) - out).max() < 1e-3
    assert most < 40e6  # all rows of the batch at once are some 120 MB, and were held four times


def spans_by_force(rows):
    """What is left of each text, for texts of plain lines as sentences."""
    cut = {d: [s for s in re.split(r"(?<=[.!?])\s+|\n", t or "") if split(s)] for d, t in rows}
    seen, gone = {}, collections.defaultdict(set)
    for d in sorted(cut):
        n = [len(split(s)) for s in cut[d]]
        runs = set()
        for i in range(len(n)):
            e, b = i, i
            while e < len(n) and (e - i + 1 < 3 or sum(n[i : e + 1]) < 15):
                e += 1
            while b >= 0 and (i - b + 1 < 3 or sum(n[b : i + 1]) < 15):
                b -= 1
            runs |= {(i, e)} if e < len(n) else set()
            runs |= {(b, i)} if b >= 0 else set()
            runs |= {(i, i)} if n[i] >= 50 else set()
            runs |= {(i, i + 1)} if i + 1 < len(n) and n[i] + n[i + 1] >= 40 else set()
        for i, e in sorted(runs):
            key = tuple(tuple(split(s.lower())) for s in cut[d][i : e + 1])
            if seen.setdefault(tuple(w for s in key for w in s), (d, i)) != (d, i):
                gone[d] |= set(range(i, e + 1))
    return {d: (len(cut[d]), len(gone[d])) for d in cut}


def test_spans(spark, docs, empty):
    passage = prose(70)
    rows = [r for r in ROWS if r[0] is not None and r[0] != 5 and r[0] not in (27, 28)]
    rows += [(300, prose(30) + "\n" + passage + "\n" + prose(30)), (301, prose(20) + "\n" + passage.upper() + "  " + prose(50)), (302, "\n".join(["Same line here now."] * 12)), (303, "Yes. No. Oh. " + prose(40)), (304, "Yes. No. Oh. " + prose(40))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("x"))
    got = ten.remove_repeats(frame).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed) for r in got} == spans_by_force(rows)
    text = {r.doc_id: r.text for r in got}
    assert text[300] == dict(rows)[300] and passage.upper() not in text[301] and len(split(text[301])) == 70 and text[20] == "" and text[22] is None
    assert ten.remove_repeats(docs).count() == len(ROWS) and ten.remove_repeats(empty).isEmpty()


def test_plain_spans(spark):
    """With 0 for all word counts: runs of three sentences, however short."""
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(rng.choice("ab") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    seen, want = set(), {}
    for d, t in rows:
        lines, gone = [x for x in t.split("\n") if x], set()
        for i in range(len(lines) - 2):
            run = tuple(" ".join(lines[i : i + 3]).split())
            gone |= {i, i + 1, i + 2} if run in seen else set()
            seen.add(run)
        want[d] = (len(lines), len(gone))
    got = ten.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), min_words=0, pair_words=0, long_words=0)
    assert {r.doc_id: (r.n_sentences, r.n_removed) for r in got.collect()} == want and sum(g > 0 for _, g in want.values()) > 10


def test_spans_of_null_and_repeated_ids(spark):
    passage, other = prose(70), prose(60)
    rows = [(None, prose(40) + "\n" + passage), (None, prose(40) + "\n" + passage), (None, passage + "\n" + prose(90)), (None, prose(30)), (None, prose(18) + "\n" + passage)]
    rows += [(7, other + "\n" + prose(200)), (7, prose(120) + "\n" + other), (7, prose(9)), (7, other), (8, other + "\n" + passage), (None, rows[1][1]), (7, other), (9, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    key = {(r[0], r[3]): (r[0] is not None, r[0] or 0, r[1], r[2]) for r in ten.keyed(frame).select(*ten.KEY, "text").collect()}
    want = spans_by_force([(key[r], r[1]) for r in rows])
    got = ten.remove_repeats(frame).collect()
    assert sum(n > 0 for _, n in want.values()) > 4 and len(got) == len(rows)
    # what is left is told from its text: removals keep the order of the words
    left = collections.Counter((r.doc_id, r.n_sentences, r.n_removed) for r in got)
    assert left == collections.Counter((d, *want[key[d, t]]) for d, t in rows)
    assert sum(passage.split()[5:30] == split(r.text)[i : i + 25] for r in got for i in range(len(split(r.text)))) == sum(passage in t and want[key[d, t]][1] == 0 for d, t in rows if t)
    # places of one text are bounded by it, however often its row repeats
    spans = Scratch(spark, "t").save(ten.span_table(spark.createDataFrame([(1, other), *[(None, other)] * 20], "doc_id long, text string")))
    assert spans.groupBy(*ten.KEY).count().count() == 2


def test_spans_with_clashing_columns_and_very_long_texts(spark):
    passage = prose(70)
    rows = [(1, passage, 1, 2, 3), (2, prose(40) + "\n" + passage, 1, 2, 3), (3, LONG * 3, 1, 2, 3), (4, None, 1, 2, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, d int, places int, first int")
    got = {r.doc_id: r for r in ten.remove_repeats(frame).collect()}
    assert set(frame.columns) < set(got[1].asDict()) and got[2].n_removed > 0 and (got[2].d, got[2].places, got[2].first) == (1, 2, 3)
    assert got[1].text == passage and passage not in got[2].text and got[4].text is None


def test_one_of_each_group(spark):
    """Repeats, several texts of one id, null ids, empty texts, clashes."""
    a, b, c = prose(90), prose(90), prose(90)
    rows = [(1, a), (2, a), (1, a), (3, changed(a, 120)), (5, b), (5, c), (4, c), (None, a), (None, a), (6, ""), (7, None), (7, None), (8, " \n"), (9, LONG)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, d int, n int, group int")
    kept = five.one_of_each_group(frame)
    assert kept.columns == frame.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == collections.Counter([(1, a), (5, b), (4, c), (None, a), (None, a), (6, ""), (7, None), (7, None), (8, " \n"), (9, LONG)])


def test_scratch_is_shared(spark):
    scratch = Scratch(spark, "t")
    df = scratch.save(spark.range(3))
    assert df.count() == 3 and scratch.base.startswith(spark.conf.get("spark.checkpoint.dir"))
    scratch.drop()


def test_batches_are_small_in_bytes(spark):
    """What Python gets at once, of rows that are long (20 MB in all)."""
    rows = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], names=["n", "size"])

    before = [spark.conf.get(k) for k in (common.ARROW_ROWS, common.ARROW_BYTES)]
    got = Scratch(spark, "batches").save(rows.mapInArrow(run, "n long, size long")).collect()
    assert sum(r.n for r in got) == 2000 and max(r.size for r in got) < 2 * common.BATCH_BYTES < 20e6
    assert [spark.conf.get(k) for k in (common.ARROW_ROWS, common.ARROW_BYTES)] == before


def test_results_do_not_depend_on_batches(spark, docs, monkeypatch):
    frame = docs.filter("doc_id is not null").select("doc_id", "text")
    bench = spark.createDataFrame([(1, ROWS[7][1]), (2, ROWS[8][1])], "item_id long, text string")
    found = lambda: [sorted(map(tuple, f.collect())) for f in (five.join_components(frame), nine.find_matches(frame, bench).select("doc_id", "item_id"), nine.decontaminate(frame, bench).select("doc_id"))]
    want = found()
    monkeypatch.setattr(common, "BATCH_BYTES", 1000)
    monkeypatch.setattr(common, "BATCH_ROWS", 3)
    assert found() == want


def test_decontamination_leaves_no_pass_to_spark_s_batches(spark, docs):
    """A plan that runs later would send Python 10,000 rows or 64 MB at once."""
    bench = spark.createDataFrame([(1, ROWS[7][1])], "item_id long, text string")
    for frame in (nine.decontaminate(docs, bench), nine.find_matches(docs, bench)):
        assert "InArrow" not in frame._jdf.queryExecution().executedPlan().toString()


def test_shingles_are_counted_in_bounded_memory():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 1 << 30, 250_000, dtype=np.uint64) >> np.uint64(k % 2 * 12) for k in range(4)]
    packed, places, counts, want = [], [], [], collections.Counter()
    for p in parts:
        x, n = np.unique(p, return_counts=True)
        want.update(dict(zip(x.tolist(), n.tolist())))
        often = np.flatnonzero(n > 1).astype(np.int32)
        packed.append(five._pack(x))
        places.append(often.tobytes())
        counts.append(n[often].tobytes())
    size = sum(len(np.unique(p)) for p in parts)
    tracemalloc.start()
    x, n = five.merged(packed, places, counts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(x.tolist(), n.tolist())) == want
    assert most < 45 * size  # bytes


def test_sample_of_texts(spark):
    """Ids that are null or stand on many rows have no part in the sample, and
    copies count once; it does not run out however small the share."""
    rows = [(None, f"text {i}") for i in range(3000)] + [(7, f"more {i}") for i in range(3000)] + [(i, "hot copy") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.text for r in nine.sampled(frame, 0.1).collect()]
    of = lambda word: sum(t.startswith(word) for t in got)
    assert len(set(got)) == len(got) and 200 < of("text") < 400 and 200 < of("more") < 400 and of("hot") <= 1
    assert nine.sampled(frame, 1.0).count() == 6001


def test_maps_grow_with_what_they_hold():
    assert [five.map_size(n, 31) for n in (0, 10**6, 10**8, 10**9, 10**13)] == [20, 20, 27, 30, 31]
