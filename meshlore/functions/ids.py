"""Content-addressed ids and rendered texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that carry meaning of their own and are not rendered (fixed values).
RESERVED = ["name", "type", "raw_time", "time", "str_id", "t_id"]
NODE_TYPES = ["object", "hyper", "episodic", "time"]
RELATION_TYPES = ["simple", "hyper", "episodic", "time"]


def suffix(props: Column) -> Column:
    """' (k: v; k: v)' of an array<struct<k, v>>, in order, without reserved keys; empty if none is left."""
    shown = F.filter(props, lambda p: ~p.k.isin(*RESERVED))
    text = F.array_join(F.transform(shown, lambda p: F.concat_ws(": ", p.k, p.v)), "; ")
    return F.when(F.size(shown) > 0, F.concat(F.lit(" ("), text, F.lit(")"))).otherwise("")


def time_prefix(props: Column) -> Column:
    found = F.get(F.filter(props, lambda p: p.k == "time"), 0)
    return F.when(F.exists(props, lambda p: p.k == "time"), F.concat(found.v, F.lit(": "))).otherwise("")


def node_text(name: Column, props: Column | None = None) -> Column:
    return name if props is None else F.concat(time_prefix(props), name, suffix(props))


def create_id(text: Column) -> Column:
    return F.md5(text)


def pair_id(a: Column, b: Column) -> Column:
    """The same for both orders."""
    return F.md5(F.concat(F.greatest(a, b), F.least(a, b)))


def triplet_text(r_type: Column, s: Column, r: Column, e: Column) -> Column:
    """s, r, e: rendered parts; time triplets read 'time: event', hyper and episodic ones as their end alone."""
    return F.when(r_type == "simple", F.concat_ws(" ", s, r, e)).when(r_type.isin("hyper", "episodic"), e).when(r_type == "time", F.concat(s, F.lit(": "), e)).otherwise(F.raise_error(F.concat(F.lit("unknown relation type "), r_type)))


def triplet_id(s_type: Column, s_id: Column, r_type: Column, r_id: Column, e_type: Column, e_id: Column) -> Column:
    return F.md5(F.concat(s_type, s_id, r_type, r_id, e_type, e_id))


def cache_key(parts: Column) -> Column:
    """sha1 of the parts' sha1 one after another; order matters."""
    return F.when(F.size(parts) > 0, F.sha1(F.array_join(F.transform(parts, lambda p: F.sha1(p)), ""))).otherwise(F.raise_error(F.lit("a key needs parts")))
