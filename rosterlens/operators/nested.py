"""Deeply nested JSON into flat tables with parent-child links.

The work is one projection of higher-order functions: level k+1 is ``flatten(transform(level k, children))``, where every
node carries the key path of its ancestors, and ``inline`` turns the nodes of a target table into rows. Nothing leaves the
JVM except records that VARIANT cannot hold or that are nested more deeply than the projection is unrolled. A scanner without
recursion gives the same rows for these, and says of texts that are no JSON what is wrong with them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of containers that the projection is unrolled to; deeper records take the scanner.
UNROLLED = 16
#: Characters of paths and values that the scanner hands on at a time.
AT_ONCE = 16_000_000

_LINKS = ["child_path", "parent_path", "table_path", "ordinal", "value"]


def _depth(text: Column) -> Column:
    """Nesting depth of brackets outside strings."""
    # escapes first: a loop over alternatives would recurse with the length of the string
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda acc: acc["most"])


#: What a node holds: the value as an object or as an array, whichever it is, and whether it is an element of an array.
_NODE = "named_struct('path', {path}, 'parent', {parent}, 'table', {table}, 'ordinal', {ordinal}, 'obj', try_variant_get({v}, '$', 'map<string,variant>'), 'arr', try_variant_get({v}, '$', 'array<variant>'), 'keep', {keep})"


def _children(level: str) -> str:
    """The containers directly within the nodes of a level; scalars have no further part and are left out.

    An element object is the parent of what lies below it; an object reached by a key belongs to its nearest element.
    """
    owner = "if(n.keep AND n.obj IS NOT NULL, n.path, n.parent)"
    head, thead = "if(n.path = '', '', n.path || '/')", "if(n.table = '', '', n.table || '/')"
    by_key = _NODE.format(path=f"{head} || e.key", parent=owner, table=f"{thead} || e.key", ordinal="CAST(NULL AS INT)", v="e.value", keep="false")
    by_place = _NODE.format(path=f"{head} || CAST(i AS STRING)", parent=owner, table=f"{thead} || '*'", ordinal="i", v="x", keep="true")
    within = f"coalesce(transform(map_entries(n.obj), e -> {by_key}), transform(n.arr, (x, i) -> {by_place}))"
    return f"flatten(transform({level}, n -> filter({within}, c -> c.obj IS NOT NULL OR c.arr IS NOT NULL)))"


def complete_json(text: Column) -> Column:
    """The text as VARIANT if it is exactly one JSON value that VARIANT can hold, else null (cut-off, trailing characters, null, blank,
    an object that names one key twice, more than some 1,000 levels)."""
    # wrapped in brackets, because the parser itself stops after the first value
    boxed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("\n]"))), "$", "array<variant>")
    return F.when(F.size(boxed) == 1, F.element_at(boxed, 1))


def json_elements(df: DataFrame, text: str, keys: list[str], unrolled: int = UNROLLED, values: bool = True) -> DataFrame:
    """One row for each JSON object that is an element of an array, at any depth, of a complete JSON text.

    Columns: the keys, then ``child_path`` (keys and zero-based positions from the root, joined with ``/``),
    ``parent_path`` (the nearest enclosing element object, null if there is none), ``table_path`` (the path with ``*`` for
    positions: rows of one target table share it), ``ordinal`` (position in its array) and ``value`` (the object as VARIANT
    renders it, or as it stands if VARIANT cannot hold it; left out without ``values``).
    Of a key that an object names twice the last value counts. Null, blank or incomplete texts and texts without such objects
    give no rows (see json_rejects); repeated input rows give repeated rows; other columns of df are not carried, so their
    names cannot clash. Keys must not be named like the five columns. What a record gives does not depend on its depth.
    """
    if set(keys) & set(_LINKS):
        raise ValueError(f"keys are named like columns of the result: {sorted(set(keys) & set(_LINKS))}")
    src = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text")).filter(F.col("__text").rlike(r"[\[{]"))
    src = src.withColumn("__v", F.when(_depth(F.col("__text")) <= unrolled, complete_json(F.col("__text"))))

    out = src.filter(F.col("__v").isNotNull())
    root = _NODE.format(path="''", parent="CAST(NULL AS STRING)", table="''", ordinal="CAST(NULL AS INT)", v="__v", keep="false")
    out = out.select(*keys, F.expr(f"array({root})").alias("__l0"))
    for k in range(unrolled):
        out = out.select("*", F.expr(_children(f"__l{k}")).alias(f"__l{k + 1}"))
    value = "to_json(n.obj)" if values else "CAST(NULL AS STRING)"
    link = f"named_struct('child_path', n.path, 'parent_path', n.parent, 'table_path', n.table, 'ordinal', n.ordinal, 'value', {value})"
    rows = ", ".join(f"transform(filter(__l{k + 1}, n -> n.keep AND n.obj IS NOT NULL), n -> {link})" for k in range(unrolled))
    flat = out.select(*keys, F.expr(f"inline(concat({rows}))"))

    deep = src.filter(F.col("__v").isNull()).select(*keys, "__text")
    schema = T.StructType([deep.schema[k] for k in keys] + [flat.schema[c] for c in _LINKS])
    scanned = deep.mapInArrow(_scanner(len(keys), schema.names, values), schema)
    held = F.try_variant_get(complete_json(F.col("value")), "$", "map<string,variant>")
    both = flat.unionByName(scanned.withColumn("value", F.coalesce(F.to_json(held), F.col("value"))))
    return both if values else both.drop("value")


def json_rejects(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The keys, ``reason`` and ``place`` (characters before it) of every text that is not null and not one complete JSON value.

    Reasons: ``empty`` (nothing but white space), ``cut off`` (the text ends too early), ``trailing`` (something follows the
    value), ``syntax``. Repeated rows are reported as often.
    """
    src = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text")).filter(F.col("__text").isNotNull() & complete_json(F.col("__text")).isNull())
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField("reason", T.StringType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                try:
                    scan(t)
                except NoJson as e:
                    told.append((i, e.reason, e.place))
            at = batch.take(pa.array([x[0] for x in told], pa.int64()))
            yield pa.RecordBatch.from_arrays([*at.columns[: len(keys)], pa.array([x[1] for x in told], pa.string()), pa.array([x[2] for x in told], pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


class NoJson(ValueError):
    """Why a text is no JSON, and where."""

    def __init__(self, reason: str, place: int):
        super().__init__(f"{reason} at {place}")
        self.reason, self.place = reason, place


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null")


def scan(text: str) -> list[tuple[list, list | None, int, int]]:
    """(steps, steps of the nearest enclosing element, from, to) of every element object of a JSON text, outermost first.

    Steps are keys (str) and positions (int). A stack in place of recursion: depth is bounded by memory alone.
    """
    rows: list = []
    steps: list = []  # of the value at hand
    # of each open container: the row it is, the row it belongs to, and of an object the rows below each key
    frames: list[tuple[int, int, dict | None]] = []
    size, at = len(text), 0

    def space() -> int:
        return _SPACE.match(text, at).end()

    def wrong() -> NoJson:
        return NoJson("cut off" if at >= size else "syntax", at)

    def key() -> None:
        """Reads a key and its colon; what an earlier one of that name held is dropped."""
        nonlocal at
        if at >= size or text[at] != '"':
            raise wrong()
        begin = at
        try:
            name, at = scanstring(text, at + 1, True)
        except ValueError:
            raise NoJson("cut off" if not re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL).match(text, begin) else "syntax", begin) from None
        at = space()
        if at >= size or text[at] != ":":
            raise wrong()
        at += 1
        held = frames[-1][2]
        if name in held:
            a, b = held[name]
            rows[a:b] = [None] * (b - a)
        held[name] = (len(rows), len(rows))
        steps.append(name)

    def close() -> None:
        nonlocal at
        own, _, _ = frames.pop()
        at += 1
        if own >= 0 and rows[own] is not None:
            rows[own][3] = at

    at = space()
    if at >= size:
        raise NoJson("empty", 0)
    while True:
        # a value begins
        at = space()
        c = text[at : at + 1]
        opened = False
        if c in ("{", "["):
            owner = -1 if not frames else frames[-1][0] if frames[-1][0] >= 0 else frames[-1][1]
            own = -1
            if c == "{" and frames and frames[-1][2] is None:
                own = len(rows)
                rows.append([list(steps), owner, at, 0])
            frames.append((own, owner, {} if c == "{" else None))
            at += 1
            at = space()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                close()
            else:
                opened = True
                if c == "{":
                    key()
                else:
                    steps.append(0)
        elif c == '"':
            begin = at
            try:
                _, at = scanstring(text, at + 1, True)
            except ValueError:
                raise NoJson("cut off" if not re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL).match(text, begin) else "syntax", begin) from None
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise NoJson("cut off" if any(w.startswith(text[at:]) for w in ("true", "false", "null", "-")) else "syntax", at)
            at = m.end()
        if opened:
            continue
        # a value has ended, and with it perhaps what holds it
        while True:
            at = space()
            if not frames:
                if at < size:
                    raise NoJson("trailing", at)
                return [(r[0], rows[r[1]][0] if r[1] >= 0 else None, r[2], r[3]) for r in rows if r is not None]
            held = frames[-1][2]
            if held is not None:
                held[steps[-1]] = (held[steps[-1]][0], len(rows))
            c = text[at : at + 1]
            if c == ",":
                at += 1
                if held is None:
                    steps[-1] += 1
                else:
                    steps.pop()
                    at = space()
                    key()
                break
            if c != ("]" if held is None else "}"):
                raise wrong()
            steps.pop()
            close()


def _scanner(keys: int, names: list[str], values: bool):
    """Element rows of records beyond the projection; what is no JSON gives none."""

    def told(batch: pa.RecordBatch, at: list[int], cols: dict[str, list]) -> pa.RecordBatch:
        kept = batch.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns[:keys], *[pa.array(cols[c], pa.int32() if c == "ordinal" else pa.string()) for c in _LINKS]], names=names)

    def joined(steps: list | None, table: bool = False) -> str | None:
        if steps is None:
            return None
        return "/".join("*" if table and isinstance(x, int) else str(x) for x in steps).encode("utf-8", "replace").decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, cols = [], 0, {c: [] for c in _LINKS}
            for i, text in enumerate(batch.column(keys).to_pylist()):
                try:
                    rows = scan(text)
                except NoJson:
                    continue
                for steps, parent, begin, end in rows:
                    path, value = joined(steps), text[begin:end] if values else None
                    at.append(i)
                    for c, v in zip(_LINKS, (path, joined(parent), joined(steps, True), steps[-1], value), strict=True):
                        cols[c].append(v)
                    size += 3 * len(path) + len(value or "")
                    if size > AT_ONCE:
                        yield told(batch, at, cols)
                        at, size, cols = [], 0, {c: [] for c in _LINKS}
            yield told(batch, at, cols)

    return run


def child_table(elements: DataFrame, last_key: str, columns: dict[str, str]) -> DataFrame:
    """One target table: the elements of every array under ``last_key``, with the given columns (name -> JSON path).

    The keys and the links of the rows stay in front. A key that is absent gives null.
    """
    rows = elements.filter(F.col("table_path").rlike(rf"(^|/){last_key}(/[^/*]+)?/\*$"))
    taken = [c for c in elements.columns if c not in ("value", "table_path")]
    return rows.select(*taken, *[F.get_json_object("value", p).alias(c) for c, p in columns.items()])
