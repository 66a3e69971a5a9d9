"""Property search and lookups over node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.functions.scalars import node_types


def search(nodes: DataFrame, prefix: str = "", keyword: str = "", types=(), key: str = "", value: str = "", limit: int = 0) -> DataFrame:
    """Nodes that meet all conditions, by name then id. A blank value asks for
    the key alone; a value without a key is ignored."""
    prefix, keyword, key, value = (x.strip() for x in (prefix, keyword, key, value))
    name = F.lower("name")
    if prefix:
        nodes = nodes.filter(name.startswith(prefix.lower()))
    if keyword:
        nodes = nodes.filter(name.contains(keyword.lower()))
    if kinds := node_types(types):
        nodes = nodes.filter(F.col("type").isin(*kinds))
    if key:
        held = F.from_json("properties", "map<string,string>")
        nodes = nodes.filter(F.try_element_at(held, F.lit(key)) == value if value else F.map_contains_key(held, key))
    nodes = nodes.orderBy("name", "id")
    return nodes.limit(limit) if limit > 0 else nodes


def property_keys(nodes: DataFrame) -> DataFrame:
    """Distinct property keys in use."""
    return nodes.select(F.explode(F.json_object_keys("properties")).alias("key")).distinct().orderBy("key")


def panel_search(nodes: DataFrame, text: str, limit: int = 24) -> DataFrame:
    """Nodes whose name, id or any property value holds a text."""
    low = text.strip().lower()
    values = F.map_values(F.from_json("properties", "map<string,string>"))
    hit = F.lower("name").contains(low) | F.lower("id").contains(low) | F.coalesce(F.exists(values, lambda v: F.lower(v).contains(low)), F.lit(False))
    return nodes.filter(hit).orderBy("id").limit(limit)
