"""Personal data: offset-preserving deobfuscation.

Base identifiers are found in the text as it stands. Transducers then rewrite
the text, keeping for each character of the result the source characters it
came from: look-alike characters become ASCII and invisible ones go; "at" and
"dot" disguises become "@" and "."; spelled digits become digits. The same
detectors run over the result, and what they find is mapped back to spans of
the source text. Such a span is added unless it overlaps a base span of its
kind.

Scale: one pass, text by text, without a shuffle. Each detector is linear in
the text: candidates start at an "@", a "+" or a run of digits that is not
preceded by another digit.

Defined results: null text counts as empty and has no spans; very long texts
are read whole; rows of equal doc_id, equal or not, are handled one by one; an
empty table gives no row; clashing columns named ``spans`` are replaced. Spans
of one kind never overlap; of two kinds they may, and masking joins them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provgraph.llm.common import table
from provgraph.llm.hashing import PART, slices

KINDS = ("email", "ip", "card", "phone")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match inside a run of digits would also match from the run's start.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.groups())]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]


def detect_plain(text: str) -> dict[str, list[Span]]:
    """The spans of each kind, leftmost and without overlap."""
    digit = _DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digit and "." in text else [],
        "card": cards(text) if digit else [],
        "phone": phones(text) if digit and "+" in text else [],
    }


# Look-alikes of ASCII characters, invisible characters, words.
_ALIKE = str.maketrans(
    "авеѕіјорсухкмнтгԁɡАВЕЅІЈОРСУХКМНТαοερικνυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ‐‑‒–—−․。٫",
    "abesijopcyxkmhtrdgABESIJOPCYXKMHTaoepikvuxABEZHIKMNOPTYX------...",
) | {0xFF01 + i: 0x21 + i for i in range(94)} | {zero + i: 48 + i for zero in (0x660, 0x6F0, 0x966) for i in range(10)} | {0xA0: 32, 0x2007: 32, 0x202F: 32, 0x3000: 32}
# Endings of more than two letters; any two letters may be a country's.
_ENDINGS = frozenset("com org net edu gov mil int info biz name pro app dev xyz online site shop store club tech cloud email mail blog news art museum travel jobs mobi tel cat asia".split())
# Words that stand before "at", or in place of a host, in plain prose.
_COMMON = frozenset(
    "the a an this that these those my your his her its our their me you him us them it i we he she they one all any some each both no not now then here there home work school once least most last first "
    "is are was were be been being am do does did has have had can could will would may look looks looked looking see seen find found meet met stay stayed live lives lived arrive arrived stop stopped stand stands "
    "start started end ended good bad better best and or but if so as in on at to of by for from with up out off over under about online available hosted sold made held placed point points dot dots page site more less much many today details information read visit visited "
    "el la los las un una de del en y o que es le les des et ou un une du est der die das ein eine und oder ist im am".split()
)
_HIDDEN = frozenset("­​‌‍⁠﻿")
_ODD = re.compile("[" + "".join(map(chr, _ALIKE)) + "".join(_HIDDEN) + "]")
_NUMBERS = (
    "zero one two three four five six seven eight nine",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
)
_SPELLED = {w: str(i) for names in _NUMBERS for i, w in enumerate(names.split())} | {"oh": "0"}
_NUMBER = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_GAP = r"(?:[\x20\t,]|-(?!-))+"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DOT_WORD, _AT_WORD = "(?:dot|punto|punkt)", "(?:at|arroba|arobase)"
_RUN = re.compile(rf"(?<!\w){_NUMBER}(?:{_GAP}{_NUMBER}){{2,}}(?!\w)", re.I)
_DOTTED = re.compile(rf"(?<!\w){_NUMBER}(?:{_GAP}{_NUMBER})*(?=\s+(?:dot|point)\s+(?:{_NUMBER}|[0-9])\b)|(?<=\.){_NUMBER}(?:{_GAP}{_NUMBER})*(?!\w)", re.I)
_PLUS = re.compile(r"(?<!\w)plus\s+(?=[0-9(])", re.I)
_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s*{_OPEN}\s*(?:{_DOT_WORD}|point|\.)\s*{_CLOSE}\s*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])\s+{_DOT_WORD}\s+(?=[A-Za-z0-9])|(?<=[0-9])\s+point\s+(?=[0-9])", re.I)
_HOST = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_AT = re.compile(rf"(?<=[A-Za-z0-9])\s*{_OPEN}\s*(?:{_AT_WORD}|@)\s*{_CLOSE}\s*(?={_HOST})|(?<=[A-Za-z0-9])(?:\s+@\s*|\s*@\s+)(?={_HOST})", re.I)
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9])\s+{_AT_WORD}\s+(?={_HOST})", re.I)
_BARE_HINT = re.compile(rf"\s{_AT_WORD}\s")
_EDGE = r"(?<![^\s(\[{<,.-])"
#: What makes a lower-cased text worth rewriting.
_HINT = re.compile(rf"{_EDGE}(?:{_NUMBER}(?:{_GAP}{_NUMBER}|\s+(?:dot|point)\s)|{_DOT_WORD}(?!\w))")


class Rewritten:
    """A text, and the source span that each of its characters stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = range(len(text)), range(1, len(text) + 1)

    def sub(self, pattern: re.Pattern, replace) -> bool:
        """Replace each match; its result stands for the whole match."""
        parts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            s, e = m.span()
            new = replace(m.group())
            parts += [self.text[at:s], new]
            starts += [*self.starts[at:s], *[self.starts[s]] * len(new)]
            ends += [*self.ends[at:s], *[self.ends[e - 1]] * len(new)]
            at = e
        if at:
            self.starts, self.ends = [*starts, *self.starts[at:]], [*ends, *self.ends[at:]]
            self.text = "".join(parts) + self.text[at:]
        return bool(at)

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]


def _digits(words: str) -> str:
    return "".join(_SPELLED[w] for w in re.split(r"[\s,-]+", words.lower()) if w)


def deobfuscate(text: str) -> Rewritten | None:
    """The rewritten text; None if there is nothing to rewrite."""
    out, changed = Rewritten(text), False
    if not text.isascii() and _ODD.search(text):
        changed |= out.sub(_ODD, lambda c: "" if c in _HIDDEN else c.translate(_ALIKE))
    low = out.text.lower()
    if _HINT.search(low):
        changed |= out.sub(_RUN, _digits)
        changed |= out.sub(_DOTTED, _digits)
        changed |= out.sub(_DOT, lambda _: ".")
        changed |= out.sub(_DOTTED, _digits)
        changed |= out.sub(_PLUS, lambda _: "+")
    elif any(o in low for o in "[({<"):
        changed |= out.sub(_DOT, lambda _: ".")
    if "@" in low or any(o in low for o in "[({<"):
        changed |= out.sub(_AT, lambda _: "@")
    if _BARE_HINT.search(low):
        changed |= out.sub(_BARE_AT, lambda _: "@")
    return out if changed else None


def _plausible(source: str, plain: str) -> bool:
    """Whether a disguised address is one.

    Signs that people do not write otherwise are enough. Words alone need a
    host that ends like one, and neither a name nor a host that is a common
    word; of another ending, a name or host with a digit or sign in it.
    """
    if not source.isascii() or any(c in source for c in "@[({<"):
        return True
    name, _, host = plain.lower().rpartition("@")
    labels = host.split(".")
    if name in _COMMON or labels[0] in _COMMON:
        return False
    return labels[-1] in _ENDINGS or len(labels[-1]) == 2 or any(c in "0123456789._+-" for c in name + labels[0])


def find_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by start, then kind as listed; code points."""
    if not text:
        return []
    base = detect_plain(text)
    found = [(k, s, e, True) for k, spans in base.items() for s, e in spans]
    if out := deobfuscate(text):
        for kind, spans in detect_plain(out.text).items():
            for at in spans:
                s, e = out.source(at)
                if all(e <= bs or s >= be for bs, be in base[kind]) and (kind != "email" or _plausible(text[s:e], out.text[slice(*at)])):
                    found.append((kind, s, e, False))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, base)."""
    kept = [c for c in docs.columns if c.lower() != "spans"]
    rows = docs.select(*kept)
    at = kept.index("text")

    def run(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "base"), s)) for s in find_spans(x)] for x in batch.column(at).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("spans", SPANS)]))


def mask(text: str | None) -> str | None:
    """``text`` with each span replaced by its kind, as in [EMAIL]."""
    spans = find_spans(text)
    if not spans:
        return text
    parts, at = [], 0
    for kind, s, e, _ in spans:
        if s < at:  # overlaps the one before: one mask for both
            at = max(at, e)
            continue
        parts += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(parts) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text``, all else as it was."""
    at = docs.columns.index("text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, at, PART):
                masked = pa.array([mask(x) for x in batch.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([masked if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _joined(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data of every document."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), added)
