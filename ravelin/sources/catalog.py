"""Tables that belong together: key links between them and look-ups along the links."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ravelin.functions.names import name_tokens
from ravelin.operators.quality import distinct_counts

#: Least share of a column's distinct values that must exist in the table it refers to.
OVERLAP = 0.5
DEPTH = 2


@dataclass(frozen=True)
class Link:
    """A column that refers to a column of unique values in another table."""

    table: str
    column: str
    lookup: str
    lookup_column: str


@dataclass
class Catalog:
    """Named tables. Link discovery reads each table once for all its columns."""

    tables: dict[str, DataFrame]
    keys: dict[str, dict[str, str]] = field(default_factory=dict)

    def default(self) -> str:
        """The widest table; of equally wide ones the longest."""
        widest = max(len(d.columns) for d in self.tables.values())
        wide = [n for n, d in self.tables.items() if len(d.columns) == widest]
        return wide[0] if len(wide) == 1 else max(wide, key=lambda n: self.tables[n].count())


def key_text(c: Column | str) -> Column:
    """A key as text: 101, 101.0 and ' 101' are one key."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^-?\d+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(F.when(text == "", None).otherwise(text))


def key_name(name: str) -> str:
    """A key column's name without the prefix of its table: l_orderkey and o_orderkey meet."""
    tokens = name_tokens(name)
    if len(tokens) > 1 and len(tokens[0]) <= 2:
        tokens = tokens[1:]
    return "".join(tokens)


def is_key(name: str) -> bool:
    return key_name(name).endswith(("key", "id", "code"))


def discover_links(catalog: Catalog, overlap: float = OVERLAP) -> list[Link]:
    """Links whose names agree, whose target is unique and that find enough of their keys there."""
    unique: dict[str, list[str]] = {}
    for name, df in catalog.tables.items():
        keys = [c for c in df.columns if is_key(c)]
        if keys:
            rows = df.count()
            counts = {x["column"]: x["unique"] for x in distinct_counts(df, keys).collect()}
            unique[name] = [c for c in keys if counts.get(c) == rows > 0]
    out = []
    for name, df in catalog.tables.items():
        for c in (c for c in df.columns if is_key(c) and c not in unique.get(name, ())):
            for other, targets in unique.items():
                for t in targets:
                    if other != name and key_name(c) == key_name(t) and key_overlap(df, c, catalog.tables[other], t).first()["overlap"] >= overlap:
                        out.append(Link(name, c, other, t))
    return sorted(out, key=lambda x: (x.table, x.column, x.lookup))


def key_overlap(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """(keys, found, overlap): distinct keys of a column, and those that exist in another table."""
    keys = df.select(key_text(column).alias("k")).na.drop().distinct()
    there = other.select(key_text(other_column).alias("k"), F.lit(1).alias("_there")).na.drop().distinct()
    d = keys.join(there, "k", "left").agg(F.count(F.lit(1)).alias("keys"), F.count("_there").alias("found"))
    return d.withColumn("overlap", F.coalesce(F.try_divide(F.col("found"), F.col("keys")), F.lit(0.0)))


def lookup(df: DataFrame, column: str, other: DataFrame, other_column: str, label: str) -> DataFrame:
    """df with the columns of the row that the key refers to. Rows stay as many as they are.

    Clashing names get the looked-up table's name in front. Spark broadcasts the other table if it is small, by its own
    size check, and joins by shuffle else.
    """
    there = other.dropDuplicates([other_column])
    names = {c: c if c not in df.columns else f"{label}_{c}" for c in there.columns if c != other_column}
    there = there.select(F.col(other_column).alias("_key"), *[F.col(c).alias(n) for c, n in names.items()])
    return df.join(there, df[column] == there["_key"], "left").drop("_key")


def enrich(catalog: Catalog, name: str, links: list[Link] | None = None, depth: int = DEPTH) -> tuple[DataFrame, dict[str, str]]:
    """The table with all columns that links lead to, breadth first; and the table that each came from."""
    links = discover_links(catalog) if links is None else links
    out, source = catalog.tables[name], dict.fromkeys(catalog.tables[name].columns, name)
    seen, front = {name}, [(name, {c: c for c in catalog.tables[name].columns})]
    for _ in range(depth):
        ahead = []
        for table, names in front:
            for link in (x for x in links if x.table == table and x.lookup not in seen):
                seen.add(link.lookup)
                before = set(out.columns)
                out = lookup(out, names[link.column], catalog.tables[link.lookup], link.lookup_column, link.lookup)
                mine = {c: c if c in out.columns and c not in before else f"{link.lookup}_{c}" for c in catalog.tables[link.lookup].columns if c != link.lookup_column}
                source |= dict.fromkeys(mine.values(), link.lookup)
                ahead.append((link.lookup, mine))
        front = ahead
    return out, source
