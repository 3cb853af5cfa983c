"""Loading delimited records while setting aside those that cannot be loaded, each with its reason.

Records are parsed in blocks by Arrow's columnar CSV reader. A block whose parse does not line up with its records is cut in
half again and again until each bad record stands alone; those are diagnosed by a strict scan, character by character. Other
records reach Python's row-at-a-time path only if they hold a line break outside quotes or their delimiter is none the reader takes. What
a look at all records of a block tells of their quotes and delimiters spares the parses that would fail.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields a heading can stand for, in the order of the result's columns.
FIELDS = ["row_id", "name", "role", "active_year", "country", "context", "client", "notes"]
YEARS = (1800, 2100)
#: Records in the first block of a dialect; a block is halved where it fails.
BLOCK = 512

_YEAR = r"^([0-9]{4})(\.0)?$"


def split_record(raw: str, delimiter: str) -> list[str] | None:
    """The fields of one record, or None if its quoting is broken.

    A field that begins with ``"`` ends at the next single ``"``, which only the delimiter or the end may follow; ``""``
    inside is a quote. A quote within any other field is an ordinary character. An empty record has one empty field.
    """
    fields, i, n = [], 0, len(raw)
    while True:
        if i < n and raw[i] == '"':
            parts, i = [], i + 1
            while True:
                j = raw.find('"', i)
                if j < 0:
                    return None
                parts.append(raw[i:j])
                if raw.startswith('"', j + 1):
                    parts.append('"')
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < n and not raw.startswith(delimiter, i):
                return None
            fields.append("".join(parts))
        else:
            j = raw.find(delimiter, i)
            j = n if j < 0 else j
            fields.append(raw[i:j])
            i = j
        if i >= n:
            return fields
        i += len(delimiter)


def _strict(delimiter: str) -> str:
    d = re.escape(delimiter)
    field = rf'(?:"(?:[^"]|"")*"|[^"{d}][^{d}]*)?'
    return rf"(?s)\A{field}(?:{d}{field})*\z"


def _columns(raws: pa.Array, delimiter: str, width: int) -> list[pa.Array] | None:
    """The block's columns if every record parses to ``width`` fields, else None."""
    # each record is led by its number: a record that swallows the next one, or breaks in two, no longer lines up
    numbers = pa.array(np.arange(len(raws)).astype(str).astype(object), pa.string())
    text = "\n".join(pc.binary_join_element_wise(numbers, raws, delimiter).to_pylist()).encode("utf-8", "surrogatepass") + b"\n"
    names = [str(i) for i in range(width + 1)]
    try:
        t = pcsv.read_csv(
            io.BytesIO(text),
            read_options=pcsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 16, len(text) + 1)),
            parse_options=pcsv.ParseOptions(delimiter=delimiter, newlines_in_values=True, ignore_empty_lines=False),
            convert_options=pcsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
        ).combine_chunks()
    except pa.ArrowInvalid:
        return None
    if t.num_rows != len(raws) or not t.column(0).combine_chunks().equals(numbers):
        return None
    return [t.column(i + 1).combine_chunks() for i in range(width)]


def _suspect(raws: pa.Array, delimiter: str, width: int) -> np.ndarray:
    """Which records the columnar reader would not parse to ``width`` fields, as far as can be told of all at once."""
    if len(delimiter) != 1 or delimiter in '"\r\n' or ord(delimiter) > 127:
        return np.ones(len(raws), bool)  # beyond the columnar reader: every record is scanned strictly
    flags = lambda x: x.to_numpy(zero_copy_only=False)
    quoted = flags(pc.match_substring(raws, '"'))
    # the reader takes a carriage return, and a line break outside quotes, for the end of a record
    out = flags(pc.match_substring(raws, "\r")) | (~quoted & (flags(pc.match_substring(raws, "\n")) | (flags(pc.count_substring(raws, delimiter)) != width - 1)))
    at = np.flatnonzero(quoted)
    some, d = raws.take(pa.array(at)), re.escape(delimiter)
    bare = pc.replace_substring_regex(some, rf'(^|{d})"(?:[^"]|"")*"', r"\1")  # what is left of quoted fields
    out[at] |= ~flags(pc.match_substring_regex(some, _strict(delimiter))) | (flags(pc.count_substring(bare, delimiter)) != width - 1)
    return out


def _blocks(raws: pa.Array, delimiter: str, width: int) -> Iterator[tuple[np.ndarray, list[pa.Array] | None]]:
    """(records, columns) of blocks that parse; columns is None for a single record that does not."""
    suspect = _suspect(raws, delimiter, width)
    for start in range(0, len(raws), BLOCK):
        todo, sound = [np.arange(start, min(start + BLOCK, len(raws)))], []
        while todo:
            part = todo.pop()
            if not suspect[part].any():
                sound.append(part)
            elif len(part) == 1:
                yield part, None
            else:
                todo += [part[len(part) // 2 :], part[: len(part) // 2]]
        # what is left of the block is parsed together, and halved where that fails
        todo = [np.concatenate(sound)] if sound else []
        while todo:
            part = todo.pop()
            columns = _columns(raws.take(pa.array(part)), delimiter, width)
            if columns is not None or len(part) == 1:
                yield part, columns
            else:
                todo += [part[len(part) // 2 :], part[: len(part) // 2]]


def _bad_values(place: dict[str, int], columns: list[pa.Array], n: int) -> np.ndarray:
    """Which records of a parsed block break a rule on values."""
    bad = np.zeros(n, bool)
    for field, rule in (("name", r"[^ ]"), ("row_id", r"^ *[0-9]+ *$"), ("active_year", None)):
        if field not in place:
            continue
        c = columns[place[field]]
        if rule:
            bad |= ~pc.match_substring_regex(c, "(?s)" + rule).to_numpy(zero_copy_only=False)
        else:
            c = pc.utf8_trim(c, " ")
            fits = pc.match_substring_regex(c, _YEAR).to_numpy(zero_copy_only=False)
            year = pc.cast(pc.if_else(pa.array(fits), pc.utf8_slice_codeunits(c, 0, 4), "0"), pa.int32()).to_numpy(zero_copy_only=False)
            empty = pc.equal(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
            bad |= ~(empty | (fits & (year >= YEARS[0]) & (year <= YEARS[1])))
    return bad


def diagnose(raw: str, delimiter: str, width: int, place: dict[str, int]) -> tuple[str | None, str | None, list[str] | None]:
    """(reason, detail, fields) of one record, by the rules in their order; reason is None if it can be loaded."""
    fields = split_record(raw, delimiter)
    if fields is None:
        return "quoting", "a quoted field is not closed, or something follows its closing quote", None
    if len(fields) != width:
        return "columns", f"{len(fields)} fields, the heading has {width}", fields
    trimmed = {f: fields[i].strip(" ") for f, i in place.items()}
    if "name" in trimmed and not trimmed["name"]:
        return "value", "name is empty", fields
    if "row_id" in trimmed and not re.fullmatch("[0-9]+", trimmed["row_id"]):
        return "value", f"row_id is not a number: {trimmed['row_id']!r}", fields
    if year := trimmed.get("active_year"):
        m = re.fullmatch(_YEAR[1:-1], year)
        if not m or not YEARS[0] <= int(m[1]) <= YEARS[1]:
            return "value", f"active_year is not a year: {year!r}", fields
    return None, None, fields


def _parse(keys: list[str], schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.num_rows, len(keys)
            raws = pc.fill_null(batch.column(k), "")
            reason: list = [None] * n
            detail: list = [None] * n
            # pieces of the result: which records, and their fields as far as their dialect has them
            pieces: list[tuple[np.ndarray, dict[str, pa.Array]]] = []
            dialects = batch.column(k + 1).dictionary_encode()
            codes = pc.fill_null(dialects.indices, -1).to_numpy()
            for code in np.unique(codes).tolist():
                at = np.flatnonzero(codes == code)
                if code < 0:
                    for i in at.tolist():
                        reason[i], detail[i] = "file", "its file or the file's heading is unknown"
                    pieces.append((at, {}))
                    continue
                dialect = json.loads(dialects.dictionary[code].as_py())
                delimiter, width = dialect["delimiter"], len(dialect["fields"])
                place: dict[str, int] = {}
                for p, f in enumerate(dialect["fields"]):
                    if f in FIELDS:
                        place.setdefault(f, p)
                own = raws.take(pa.array(at))
                alone: list[tuple[int, dict[str, str | None]]] = []
                for part, columns in _blocks(own, delimiter, width):
                    if columns is not None:
                        pieces.append((at[part], {f: columns[p] for f, p in place.items()}))
                        part = part[_bad_values(place, columns, len(part))]
                    for j in part.tolist():
                        i = int(at[j])
                        reason[i], detail[i], fields = diagnose(own[j].as_py(), delimiter, width, place)
                        if columns is None:
                            alone.append((i, {f: fields[p] if fields and reason[i] in (None, "value") else None for f, p in place.items()}))
                if alone:
                    pieces.append((np.array([i for i, _ in alone]), {f: pa.array([v[f] for _, v in alone], pa.string()) for f in place}))
            back = pa.array(np.argsort(np.concatenate([x for x, _ in pieces]))) if pieces else pa.array([], pa.int64())
            values = [pa.concat_arrays([v.get(f, pa.nulls(len(x), pa.string())) for x, v in pieces]) if pieces else pa.array([], pa.string()) for f in FIELDS]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in range(k)], pa.array(reason, pa.string()), pa.array(detail, pa.string()), *[pc.utf8_trim(v.take(back), " ") for v in values]],
                names=schema.names,
            )

    return run


def guarded_parse(lines: DataFrame, files: DataFrame, key: str = "line_id", file_key: str = "file_id", raw: str = "raw_line") -> DataFrame:
    """Every record of ``lines`` with its ``reason`` (null: it loaded), ``detail`` and the fields of FIELDS, trimmed.

    ``files`` has ``delimiter``, ``header`` and ``header_map`` for each ``file_key``; a file given twice counts once. The
    reasons, of which the first that holds is given: ``file`` (the file or its heading is unknown), ``quoting``,
    ``columns``, ``value``. A null record is an empty one; a null delimiter is a comma; where two headings stand for one
    field the first counts; a field no heading stands for is null. Repeated records give repeated rows. Further columns of
    either table are not carried, so their names cannot clash. Memory is bounded by Arrow's batch, whatever the size of a
    file; the join is left to the optimiser, which broadcasts ``files`` only below its threshold and splits hot files.
    """
    # a file's dialect is one short text, so that a batch tells its dialects apart without looking at its rows
    fields = F.transform("header", lambda h: F.coalesce(F.try_element_at("header_map", h), F.lit("")))
    dialect = F.when(F.col("header").isNotNull(), F.to_json(F.struct(F.when(F.coalesce("delimiter", F.lit("")) == "", ",").otherwise(F.col("delimiter")).alias("delimiter"), F.when(F.col("header_map").isNull(), F.transform("header", lambda h: F.lit(""))).otherwise(fields).alias("fields"))))
    told = files.select(F.col(file_key).alias("__file"), dialect.alias("__dialect")).dropDuplicates(["__file"])
    keys = [key, file_key]
    j = lines.select(*keys, F.col(raw).alias("__raw")).join(told, F.col(file_key) == F.col("__file"), "left").select(*keys, "__raw", "__dialect")
    schema = T.StructType([j.schema[k] for k in keys] + [T.StructField(c, T.StringType()) for c in ("reason", "detail", *FIELDS)])
    return j.mapInArrow(_parse(keys, schema), schema)
