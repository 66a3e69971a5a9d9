"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provgraph.errors import ValidationError
from provgraph.schema import NODE_TYPES, RELATIONS

# Property keys and words that state a risk.
RISK_KEYS = ("risk_level", "risk", "风险等级", "风险")
RISK_WORDS = {"critical": ("critical", "严重", "致命"), "high": ("high", "高"), "medium": ("medium", "mid", "中"), "low": ("low", "低")}
NO_VALUE = "—"
LABELS = {"node_created": "Node created", "node_updated": "Node updated", "node_deleted": "Node deleted", "edge_created": "Edge created", "edge_updated": "Edge updated", "edge_deleted": "Edge deleted"}


def parse_time(text: Column) -> Column:
    """A +08:00 wall-clock timestamp from the accepted layouts, else null.

    Offsets are honoured; a text without one is read as +08:00.
    """
    fixed = F.regexp_replace(F.trim(text), r"(\d{2}:\d{2}(?:\.\d+)?) (\d{2}:\d{2})$", "$1+$2")
    zoned = fixed.rlike(r"(?:[zZ]|[+-]\d{2}:\d{2})$")
    instant = F.try_to_timestamp(F.when(zoned, fixed).otherwise(F.concat(fixed, F.lit("+08:00"))))
    day = F.try_to_timestamp(F.when(fixed.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(fixed, F.lit("T00:00:00+08:00"))))
    shaped = fixed.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[zZ]|[+-]\d{2}:\d{2})?$")
    there = F.coalesce(F.when(shaped, instant), day)
    return F.convert_timezone(F.current_timezone(), F.lit("+08:00"), there.cast("timestamp_ntz"))


def format_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def _wall(t: Column) -> Column:
    """An instant as +08:00 wall-clock time."""
    return F.convert_timezone(F.current_timezone(), F.lit("+08:00"), t.cast("timestamp_ntz"))


def format_local(t: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A timestamp with time zone as +08:00 wall-clock text; a dash for none."""
    return F.coalesce(F.date_format(_wall(t), pattern), F.lit(NO_VALUE))


def format_short(t: Column) -> Column:
    return format_local(t, "MM-dd HH:mm")


def format_date(t: Column) -> Column:
    return format_local(t, "yyyy-MM-dd")


def format_offset(t: Column) -> Column:
    """ISO text that ends in +08:00; empty for none."""
    return F.coalesce(F.concat(F.date_format(_wall(t), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")), F.lit(""))


def format_number(n: Column) -> Column:
    """With thousands separated, at most three decimals; a dash for none."""
    text = F.format_number(F.round(n.cast("double"), 3), 3)
    return F.when(n.isNull() | F.isnan(n.cast("double")), NO_VALUE).otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def format_decimal(n: Column, digits: int = 2) -> Column:
    """Rounded, without zeros at the end; a dash for none."""
    text = F.round(n.cast("decimal(30,10)"), digits).cast("string")
    return F.when(n.isNull() | F.isnan(n.cast("double")), NO_VALUE).otherwise(F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text))


def relative_time(t: Column, now: Column) -> Column:
    """How long before ``now``, in the largest whole unit."""
    s = F.timestamp_diff("SECOND", t, now)
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(f" {name} ago"))
    return F.when(s < 60, "just now").when(s < 3600, unit(60, "minutes")).when(s < 86400, unit(3600, "hours")).when(s < 30 * 86400, unit(86400, "days")).otherwise(F.date_format(t, "yyyy-MM-dd"))


def event_label(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(LABELS.items()):
        out = F.when(event_type == k, v).otherwise(out)
    return out


def middle_ellipsis(text: Column, most: int = 24) -> Column:
    head = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("…"), F.right(text, F.lit(most - 1 - head))))


def node_size(degree: Column, least: float = 20.0, step: float = 6.0, most: float = 46.0) -> Column:
    """A drawing size that grows with the root of the degree."""
    return F.least(F.lit(least) + step * F.sqrt(degree), F.lit(most))


def merge_properties(old: Column, new: Column, replace: bool = False) -> Column:
    """Union of two JSON objects in which ``new`` wins and null deletes."""
    parsed = lambda c: F.from_json(F.coalesce(c, F.lit("{}")), "map<string,variant>")
    if replace:
        return F.coalesce(new, F.lit("{}"))
    gone = F.map_filter(parsed(new), lambda _, v: F.is_variant_null(v))
    kept = F.map_filter(parsed(old), lambda k, _: ~F.map_contains_key(parsed(new), k))
    put = F.map_filter(parsed(new), lambda k, _: ~F.map_contains_key(gone, k))
    return F.to_json(F.map_concat(kept, put))


def risk_of(properties: Column) -> Column:
    """critical, high, medium or low; the first key that states one counts."""
    values = F.from_json(properties, "map<string,string>")
    low = F.transform_keys(values, lambda k, _: F.lower(k))
    out = F.lit(None).cast("string")
    for key in reversed(RISK_KEYS):
        word = F.lower(F.trim(F.try_element_at(low, F.lit(key))))
        said = F.lit(None).cast("string")
        for level, names in RISK_WORDS.items():
            said = F.when(word.isin(*names), level).otherwise(said)
        out = F.coalesce(said, out)
    return out


def direction_of(text: str | None) -> str:
    """out, in or both, from any accepted name."""
    name = (text or "").strip().lower()
    for canonical, names in {"out": ("", "out", "downstream"), "in": ("in", "upstream"), "both": ("both", "all")}.items():
        if name in names:
            return canonical
    raise ValidationError(f"unknown direction {text!r}")


def listed(values, allowed: tuple[str, ...]) -> list[str]:
    """Values of a comma-separated text or list, without blanks or repeats."""
    parts = [p.strip() for v in ([values] if isinstance(values, str) else values or []) for p in v.split(",")]
    parts = list(dict.fromkeys(p for p in parts if p))
    if unknown := [p for p in parts if p not in allowed]:
        raise ValidationError(f"unknown values {unknown}")
    return parts


def node_types(values) -> list[str]:
    return listed(values, NODE_TYPES)


def relations(values) -> list[str]:
    return listed(values, RELATIONS)
