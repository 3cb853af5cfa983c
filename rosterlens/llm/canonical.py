"""Mapping freely typed values to the entries of a reference list with a BK-tree.

The tree is built under the unrestricted Damerau-Levenshtein distance, which, other than the restricted one, is a metric, so
the triangle inequality prunes without losing an entry. Distinct values are searched once and joined back to their rows. A
list of proven size goes to the executors whole; a longer one is sharded: every distinct value meets every shard's tree, block
by block, and the shards' winners are merged. What a form is worth depends on that form alone, so both ways give the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries, other names included, up to which a list is sent to the executors whole (some 100 bytes each).
WHOLE = 50_000
#: Values and entries of a list beyond WHOLE that meet in one task.
BLOCK = 50_000
NONE = "none"
#: Rank of forms that must be met but for one edit, names in other languages, and of those that must be met exactly: ids, codes.
NEARLY, EXACT = 2, 3

Entry = tuple[str, str, int]  # normal form, id, rank among ties

#: Notes that typists add to a value and that say nothing about it.
_NOTES = re.compile(r"\((?:main|primary)\)", re.IGNORECASE)


def normal_form(value: str) -> str:
    """Compatibility forms, case, accents, marks and spacing levelled."""
    s = unicodedata.normalize("NFKD", _NOTES.sub(" ", value)).casefold()
    s = "".join(c if c.isalnum() or (unicodedata.category(c)[0] == "M" and not unicodedata.combining(c)) else "" if unicodedata.category(c)[0] in "MC" and not c.isspace() else " " for c in s)
    return " ".join(s.split())


#: What parts of a value stand between.
_BREAKS = re.compile(r"[,;/()]")
#: A word cut short with a point.
_SHORT = re.compile(r"(?<![^\W_])([^\W_]{3,}+)\.")


def forms(value: str) -> list[str]:
    """The normal form and, of a value with a comma or a bracket, also that with the part behind it in front."""
    out = [normal_form(value)]
    value = _NOTES.sub(" ", value)
    if "," in value:
        front, _, back = value.rpartition(",")
        out.append(normal_form(f"{back} {front}"))
    if "(" in value:
        front, _, back = value.partition("(")
        out.append(normal_form(f"{back} {front}"))
    return [x for x in dict.fromkeys(out) if x]


def edit_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: a metric."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    most = n + m
    last: dict[str, int] = {}
    d = [[most] * (m + 2) for _ in range(n + 2)]
    d[1] = [most, *range(m + 1)]
    for i in range(1, n + 1):
        ca, row, above, seen = a[i - 1], d[i + 1], d[i], 0
        row[1] = i
        for j in range(1, m + 1):
            cb = b[j - 1]
            k, at = last.get(cb, 0), seen
            if ca == cb:
                best, seen = above[j], j
            else:
                best = above[j] + 1
            x = above[j + 1] + 1
            best = min(x, best)
            x = row[j] + 1
            best = min(x, best)
            x = d[k][at] + i - k - 1 + 1 + j - at - 1
            row[j + 1] = min(x, best)
        last[ca] = i
    return d[n + 1][m + 1]


def allowed(form: str, rank: int) -> int:
    """Edits within which a value may stand for a form: the shorter it is, the fewer."""
    n = len(form.replace(" ", ""))
    return 0 if n <= 3 or rank == EXACT else 1 if n <= 5 or rank == NEARLY else 2


class BKTree:
    """Nodes hold the entries of one normal form; a child hangs on its distance to its parent."""

    def __init__(self, entries: Iterable[Entry]):
        self.exact: dict[str, list[Entry]] = {}
        for e in entries:
            self.exact.setdefault(e[0], []).append(e)
        self.closed: dict[str, list[str]] = {}
        self.heads: dict[str, list[str]] = {}
        for f in sorted(self.exact):
            self.closed.setdefault(f.replace(" ", ""), []).append(f)
            self.heads.setdefault(_head(f), []).append(f)
        self.longest = max(map(len, self.exact), default=0)
        self.root: tuple[str, dict] | None = None
        for form in self.exact:
            if self.root is None:
                self.root = (form, {})
                continue
            node = self.root
            while True:
                d = edit_distance(form, node[0])
                if d not in node[1]:
                    node[1][d] = (form, {})
                    break
                node = node[1][d]

    def within(self, form: str, radius: int) -> list[tuple[int, Entry]]:
        """Every entry within the radius, with its distance."""
        out, todo = [], [self.root] if self.root and len(form) <= self.longest + radius else []
        while todo:
            at, children = todo.pop()
            d = edit_distance(form, at)
            if d <= radius:
                out += [(d, e) for e in self.exact[at]]
            todo += [child for k, child in children.items() if d - radius <= k <= d + radius]
        return out

    def best(self, value: str) -> tuple[int, int, str, str] | None:
        """(distance, rank, form, id) of the nearest entry that the value may stand for.

        Every form the value may stand for counts with its own distance, whatever else the tree holds: the edits, 0 if it is
        the same, 1 if only the spacing differs or words are cut short with a point, 2 if it is one part of several.
        """
        found = []
        short = {normal_form(w) for w in _SHORT.findall(value)}
        for form in forms(value):
            found += [(0, rank, f, i) for f, i, rank in self.exact.get(form, ())]
            if form.isdigit():
                continue
            near = [f for f in self.closed.get(form.replace(" ", ""), ()) if f != form]
            if short:
                near += [f for f in self.heads.get(_head(form), ()) if _cut_short(form.split(" "), f.split(" "), short)]
            found += [(1, rank, f, i) for f in near for f, i, rank in self.exact[f] if rank != EXACT]
            nearest = min(found)[0] if found else 2  # what lies further cannot win
            if nearest:
                found += [(d, rank, f, i) for d, (f, i, rank) in self.within(form, nearest) if d <= allowed(f, rank)]
        parts = _BREAKS.split(_NOTES.sub(" ", value))
        if len(parts) > 1:
            found += [(2, rank, f, i) for p in parts for f, i, rank in self.exact.get(normal_form(p), ())]
        return min(found, key=_order, default=None)


def _head(form: str) -> str:
    return " ".join(w[:3] for w in form.split(" "))


def _cut_short(words: list[str], entry: list[str], short: set[str]) -> bool:
    return all(a == b or (a in short and b.startswith(a)) for a, b in zip(words, entry, strict=True))


def _order(x: tuple[int, int, str, str]) -> tuple:
    """Of equally near entries: one of the list itself, then the longer, then by name."""
    return (x[0], x[1], -len(x[2]), x[2], x[3])


def _forms_of(i: str | None, name: str | None, more: Iterable[str] | None) -> list[Entry]:
    """The entries of one row of a list: its name, its other names, its id; the best rank of a form counts."""
    out: dict[str, int] = {}
    if i is not None:
        for rank, x in [(0, name), (EXACT, i), *[(1, x) for x in more or []]]:
            if x and normal_form(x):
                out.setdefault(normal_form(x), rank)
    return [(f, i, rank) for f, rank in out.items()]


def entries_of(rows: Iterable[tuple[str, str, list[str] | None]], other: Iterable[tuple[str, str]] = (), foreign: Iterable[tuple[str, str]] = (), exact: Iterable[tuple[str, str]] = ()) -> list[Entry]:
    """Entries from (id, name, other names) rows and from (name, other name) pairs, which rank 1, NEARLY and EXACT.

    A null id or name is passed over; of ids that share a form all stay, and the smaller wins where they tie.
    """
    rows = list(rows)
    out = {(f, i): rank for r in rows for f, i, rank in _forms_of(*r)}
    ids = {normal_form(name): i for i, name, _ in rows if i is not None and name}
    for pairs, rank in ((other, 1), (foreign, NEARLY), (exact, EXACT)):
        for name, x in pairs:
            if normal_form(x) and (i := ids.get(normal_form(name))) is not None:
                out.setdefault((normal_form(x), i), rank)
    return [(f, i, rank) for (f, i), rank in sorted(out.items(), key=lambda x: (x[1], x[0]))]


def entries_frame(df: DataFrame, key: str, name: str, others: str | None = None) -> DataFrame:
    """The entries of a list of any length, as map_to_list takes them: form, id, rank. Nothing passes the driver."""
    more = F.col(others) if others else F.lit(None).cast("array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [e for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for e in _forms_of(*row)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in told], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["form", "id", "rank"])

    rows = df.select(F.col(key).cast("string"), F.col(name), more.alias("__more"))
    return rows.mapInArrow(run, "form string, id string, rank int").groupBy("form", "id").agg(F.min("rank").alias("rank"))


_trees: dict[int, BKTree] = {}


def _tree(entries: tuple[Entry, ...]) -> BKTree:
    """Built once by each worker."""
    key = hash(entries)
    if key not in _trees:
        _trees[key] = BKTree(entries)
    return _trees[key]


_WON = "value string, d int, rank int, form string, id string"


def _search(entries: tuple[Entry, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(entries)
        for batch in batches:
            values = batch.column(0).to_pylist()
            best = [tree.best(v) or (None,) * 4 for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([b[k] for b in best], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]], names=["value", "d", "rank", "form", "id"])

    return run


def _winners(values: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    tree = BKTree([(f, i, int(r)) for f, i, r in zip(entries["form"], entries["id"], entries["rank"], strict=True)])
    told = list(values["value"])
    best = [tree.best(x) or (None,) * 4 for x in told]
    return pd.DataFrame({"value": pd.Series(told, dtype=object), **{c: pd.Series([b[k] for b in best], dtype=t) for k, (c, t) in enumerate((("d", "Int32"), ("rank", "Int32"), ("form", object), ("id", object)))}})


def _won(values: DataFrame, entries: list[Entry] | DataFrame, shards: int) -> DataFrame:
    """Of each distinct value: value, ref_id, distance of its nearest entry; none if there is none."""
    spark = values.sparkSession
    if isinstance(entries, DataFrame):
        n = entries.count()
        if not shards and n <= WHOLE:
            entries = [tuple(r) for r in entries.select("form", "id", "rank").sort("id", "form").collect()]
    else:
        n = len(entries)
    if not shards and n <= WHOLE:
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        won = values.repartition(tasks).mapInArrow(_search(tuple(entries)), _WON).filter("d IS NOT NULL")
        return won.select(F.col("value").alias("__value"), F.col("id").alias("ref_id"), F.col("d").alias("distance"))
    held = entries if isinstance(entries, DataFrame) else spark.createDataFrame(entries, "form string, id string, rank int")
    shards, blocks = shards or -(-n // BLOCK), max(1, -(-values.count() // BLOCK))  # a task holds some BLOCK of either
    held = held.select("form", "id", "rank", F.pmod(F.xxhash64("form"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = values.select("value", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    won = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInPandas(_winners, _WON).filter("d IS NOT NULL")
    best = won.groupBy("value").agg(F.min(F.struct("d", "rank", (-F.length("form")).alias("len"), "form", "id")).alias("w"))
    return best.select(F.col("value").alias("__value"), F.col("w.id").alias("ref_id"), F.col("w.d").alias("distance"))


def map_to_list(df: DataFrame, keys: list[str], lists: dict[str, list[Entry] | DataFrame], shards: int = 0) -> DataFrame:
    """One row for each row of df and each field of ``lists``: the keys, ``field``, ``value``, ``ref_id``, ``distance``.

    ``ref_id`` is the nearest entry's id, or ``none`` where no entry is near enough; it is null for a null or blank value.
    Ties are settled as in BKTree.best. Repeated rows give repeated rows, an empty list gives ``none`` everywhere; columns of
    df other than keys and fields are not carried. A list is one of entries_of or entries_frame; with ``shards`` above 0, or a
    list of more than WHOLE entries, it is sharded. The join back to the rows is left to adaptive execution, which broadcasts
    the values searched where they are few and splits a hot value where they are not.
    """
    clash = {"field", "value", "ref_id", "distance"} & set(keys)
    if clash:
        raise ValueError(f"keys are named like columns of the result: {sorted(clash)}")
    out = []
    for field, entries in lists.items():
        rows = df.select(*keys, F.lit(field).alias("field"), F.col(field).alias("value"))
        values = rows.filter(F.col("value").isNotNull() & ~_blank()).select("value").distinct()
        won = _won(values, entries, shards)
        out.append(rows.join(won, F.col("value") == F.col("__value"), "left").select(*keys, "field", "value", F.when(~_blank(), F.coalesce("ref_id", F.lit(NONE))).alias("ref_id"), "distance"))
    return reduce(DataFrame.unionByName, out)


def _blank() -> Column:
    return F.col("value").isNull() | F.col("value").rlike(r"^\s*$")
