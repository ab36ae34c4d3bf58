"""Settings documents (JSON) of several versions, read into one schema, changed and written back.

A field is looked up under its name and then under the names that older versions had; a value that was once a
default is replaced by the present one; keys that no field names are kept as they are. A document that is null,
unreadable or no object has the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAP = "map<string,variant>"


@dataclass(frozen=True)
class Field:
    name: str
    default: str
    older: tuple[str, ...] = ()
    #: values that were defaults once and become the present one
    legacy: tuple[str, ...] = field(default=())


def _first(values: Column, names: tuple[str, ...], default: str) -> Column:
    """The value of the first name that a document has, null if it is null there, else the default."""
    out = F.lit(default)
    for n in reversed(names):
        value = F.try_element_at(values, F.lit(n))
        out = F.when(F.map_contains_key(values, F.lit(n)), F.try_variant_get(value, "$", "string")).otherwise(out)
    return out


def load(documents: DataFrame, fields: list[Field], column: str = "document") -> DataFrame:
    """The other columns, one a field, rest (the other keys, as a map of variants) and migrated."""
    others = [c for c in documents.columns if c != column]
    parsed = documents.select(*others, F.coalesce(F.try_variant_get(F.try_parse_json(column), "$", _MAP), F.create_map().cast(_MAP)).alias("_m"))
    names = [n for f in fields for n in (f.name, *f.older)]
    out, changed = [], F.lit(False)
    for f in fields:
        value = _first(F.col("_m"), (f.name, *f.older), f.default)
        old = F.coalesce(value.isin(*f.legacy), F.lit(False)) if f.legacy else F.lit(False)
        out.append(F.when(old, F.lit(f.default)).otherwise(value).alias(f.name))
        renamed = F.lit(False)
        for n in f.older:
            renamed |= F.map_contains_key("_m", F.lit(n))
        changed = changed | old | renamed
    rest = F.map_filter("_m", lambda k, _: ~k.isin(*names))
    return parsed.select(*others, *out, rest.alias("rest"), changed.alias("migrated"))


def change(settings: DataFrame, changes: DataFrame, fields: list[Field], key: str) -> DataFrame:
    """settings with the values of changes (key and some fields; null: unchanged), of each key the last by seq."""
    given = [f.name for f in fields if f.name in changes.columns]
    # each field's own last value that is not null, combined before the shuffle
    last = changes.groupBy(key).agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(f"_{n}") for n in given))
    got = settings.join(last, key, "left")
    return got.select(*(F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in settings.columns))


def save(settings: DataFrame, fields: list[Field], column: str = "document") -> DataFrame:
    """The other columns and the document of the present version: fields that are null stay null, other keys follow."""
    names = [f.name for f in fields]
    others = [c for c in settings.columns if c not in (*names, "rest", "migrated")]
    own = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("variant") for n in names)))
    return settings.select(*others, F.to_json(F.map_concat(own, "rest"), {"ignoreNullFields": "false"}).alias(column))


def moves(folders: DataFrame, renames: list[tuple[str, str]]) -> DataFrame:
    """src, dst: which old folders (owner, path) are to be moved to their new names: those that exist while the new one does not."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in renames))
    mine = folders.select("owner", "path").distinct()
    wanted = mine.select("owner", F.col("path").alias("src"), F.explode(pairs).alias("p")).where("src = p.a").select("owner", "src", F.col("p.b").alias("dst"))
    return wanted.join(mine.select("owner", F.col("path").alias("dst")), ["owner", "dst"], "left_anti").select("owner", "src", "dst")
