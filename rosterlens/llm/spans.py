"""Long exact spans that more than one record holds, found with a count-min prefilter.

First pass: every partition sketches the windows of its records, the partitions' sketches are merged by shards of cells, and
what remains of them is one bit a cell: counted twice or more. Second pass: only windows whose estimate says "repeated" are
grouped, exactly. The sketch overestimates and never underestimates, so no repeated window is lost, whatever its size.

The sketch grows with the corpus, CELLS_A_MINIMIZER cells to each minimizer a text of its length holds, so that few windows pass
that stand once. Up to MOST_CELLS it goes to the executors. A larger one is kept where the shuffle puts it, as a table of
its cells, each of which is then a 64-bit hash by itself: the minimizers of all records are counted by it and joined to it.

What is sketched of a window is its minimizer, the least of the hashes of its shorter word runs: equal windows have equal
minimizers, and neighbouring windows mostly share theirs, so a corpus has far fewer of them than windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

#: Cells of each of the sketch's rows: so many for each minimizer expected, within these bounds; a cell is one bit on the executors.
CELLS_A_MINIMIZER = 8
LEAST_CELLS, MOST_CELLS = 1 << 22, 1 << 28
#: Bytes of text for one minimizer of 30-word windows, as measured on English; other texts only change how full the sketch is.
MINIMIZER_BYTES = 64
ROWS = 2
#: Shards in which partial sketches are merged, each in its own task if there are enough; a shard is a range of cells.
SHARDS = 64
#: Records that are windowed at a time.
CHUNK = 1024

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(parts between white space, which of them are words, bounds of the records' words)."""
    parts = pc.utf8_split_whitespace(texts.fill_null(""))
    flat = parts.flatten()
    # leading and trailing white space leaves empty words
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    offsets = parts.offsets.to_numpy() - (parts.offsets[0].as_py() if len(parts) else 0)
    return flat, full, np.concatenate([[0], np.cumsum(full)])[offsets]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, bounds of the records' words); words stand between white space."""
    import xxhash

    flat, full, bounds = _parts(texts)
    coded = flat.dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = table[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    return hashes[full], bounds


def _spans(h: np.ndarray, n: int, step) -> np.ndarray:
    """step folded over every n consecutive values, by doubling."""
    size = len(h) - n + 1
    if size <= 0:
        return h[:0]
    span, covered, left, at, out = 1, 0, n, h, None
    while left:
        if left & 1:
            part = at[covered : covered + size]
            out = part if out is None else step(out, part)
            covered += span
        left >>= 1
        if left:
            at = step(at[: len(at) - span], at[span:])
            span *= 2
    return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _A + (b ^ (b >> np.uint64(32))) * _B)


def windows(texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window hash, minimizer, record, first word) of every window of so many words that lies within one record."""
    h, bounds = _words(texts)
    size = np.diff(bounds)
    starts = np.flatnonzero(np.ones(len(h), bool)) if len(h) else np.zeros(0, np.int64)
    record = np.repeat(np.arange(len(texts)), size)
    if len(h) < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    whole = _spans(h, length, _join)
    short = (length + 1) // 2
    least = _spans(_mix(_spans(h, short, _join)), length - short + 1, np.minimum)
    own = record[: len(whole)]
    inside = own == record[length - 1 :]
    first = starts[: len(whole)] - bounds[own]
    return whole[inside], least[inside], own[inside], first[inside]


def _cells(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(_mix(keys + np.uint64(r) * _B) % np.uint64(cells)).astype(np.int64) for r in range(ROWS)]


def _partial(length: int, cells: int):
    """Of a partition: for each shard of each row, the cells met once and those met again, as packed differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                _, least, record, _ = windows(batch.column(0).slice(at, CHUNK), length)
                if len(least):
                    new = np.concatenate([[True], (least[1:] != least[:-1]) | (record[1:] != record[:-1])])
                    for r, c in enumerate(_cells(least[new], cells)):
                        once[r].append(c.astype(np.int32) if cells <= 1 << 31 else c)
        shards, seen, again = [], [], []
        for r in range(ROWS):
            if not once[r]:
                continue
            c, n = np.unique(np.concatenate(once[r]).astype(np.int64), return_counts=True)
            shard = c * SHARDS // cells
            for s in np.unique(shard).tolist():
                mine = shard == s
                shards.append(r * SHARDS + s)
                seen.append(_pack(c[mine]))
                again.append(_pack(c[mine & (n > 1)]))
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(seen, pa.binary()), pa.array(again, pa.binary())], names=["shard", "seen", "again"])

    return run


def _pack(cells: np.ndarray) -> bytes:
    """Ascending numbers as differences, in as few bytes each as the largest difference takes."""
    if not len(cells):
        return b""
    d = np.diff(cells)
    size = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(d) or d.max() <= np.iinfo(t).max)
    return bytes([np.dtype(size).itemsize]) + cells[:1].astype(np.int64).tobytes() + d.astype(size).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    return np.cumsum(np.concatenate([np.frombuffer(raw[1:9], np.int64), np.frombuffer(raw[9:], f"u{raw[0]}").astype(np.int64)]))


def _merge(cells: int):
    """Merges the partial sketches of the shards of a partition; one shard's counters are in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count = None, None

        def done():
            low = (at % SHARDS * cells + SHARDS - 1) // SHARDS
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([low], pa.int64()), pa.array([np.packbits(count >= 2).tobytes()], pa.binary())], names=["shard", "low", "bits"])

        for batch in batches:
            for shard, seen, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    if at is not None:
                        yield done()
                    at, count = shard, np.zeros(cells // SHARDS + 2, np.uint8)
                low = (shard % SHARDS * cells + SHARDS - 1) // SHARDS
                for part in (seen, again):
                    c = _unpack(part) - low
                    count[c] = np.minimum(count[c] + 1, 2)
        if at is not None:
            yield done()

    return run


class Sketch:
    """Which cells were counted twice or more."""

    def __init__(self, cells: int):
        self.cells = cells
        self.bits = np.zeros((ROWS, cells // 8 + 1), np.uint8)

    def put(self, shard: int, low: int, raw: bytes) -> None:
        on = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))) + low
        on = on[on < self.cells]
        np.bitwise_or.at(self.bits[shard // SHARDS], on >> 3, (1 << (on & 7)).astype(np.uint8))

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for r, c in enumerate(_cells(keys, self.cells)):
            out &= (self.bits[r][c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
        return out


def cells_for(size: int, length: int) -> int:
    """Cells for a corpus of so many bytes: a power of two, at least LEAST_CELLS. Longer windows have fewer minimizers."""
    wanted = CELLS_A_MINIMIZER * size * 30 // (MINIMIZER_BYTES * length)
    return max(LEAST_CELLS, 1 << max(0, wanted - 1).bit_length())


def sketch(texts: DataFrame, length: int, cells: int) -> Sketch:
    """The merged sketch of the windows of the one string column of texts."""
    parts = texts.mapInArrow(_partial(length, cells), "shard int, seen binary, again binary")
    tasks = max(16, min(ROWS * SHARDS, texts.sparkSession.sparkContext.defaultParallelism))
    merged = parts.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_merge(cells), "shard int, low bigint, bits binary")
    out = Sketch(cells)
    for row in merged.toLocalIterator():  # ROWS * SHARDS rows, together two bits a cell
        out.put(row.shard, row.low, bytes(row.bits))
    return out


def _windowed(src: DataFrame, key: str, length: int, repeated, told: str | None = None) -> DataFrame:
    """hash, key, ``at`` of the windows whose minimizer is repeated: by the sketch, or one of the record's own in the column ``told``."""
    schema = T.StructType([T.StructField("hash", T.LongType()), src.schema[key], T.StructField("at", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                whole, least, record, first = windows(part.column(1), length)
                if told is None:
                    keep = np.flatnonzero(repeated.value.repeated(least))
                else:  # (record, minimizer) pairs, each mixed into one number
                    own = part.column(2)
                    held = np.repeat(np.arange(part.num_rows), pc.list_value_length(own).to_numpy().astype(np.int64))
                    keep = np.flatnonzero(np.isin(_join(least, record.astype(np.uint64)), _join(own.flatten().to_numpy().view(np.uint64), held.astype(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array(whole[keep].view(np.int64)), part.column(0).take(pa.array(record[keep])), pa.array(first[keep].astype(np.int32))], names=schema.names)

    return src.mapInArrow(run, schema)


def _repeated_minimizers(src: DataFrame, key: str, length: int) -> DataFrame:
    """key, ``m`` (array): the record's minimizers that other places have too, by a shuffle of all minimizers."""
    schema = T.StructType([src.schema[key], T.StructField("m", T.LongType()), T.StructField("n", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                _, least, record, _ = windows(part.column(1), length)
                new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (record[1:] != record[:-1])]) if len(least) else np.zeros(0, bool))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(record[new])), pa.array(least[new].view(np.int64)), pa.array(np.ones(len(new), np.int32))], names=schema.names)

    every = src.mapInArrow(run, schema)
    several = every.groupBy("m").agg(F.sum("n").alias("n")).filter("n > 1").select("m")
    return every.select(key, "m").join(several, "m", "left_semi").groupBy(key).agg(F.collect_set("m").alias("m"))


def candidates(docs: DataFrame, key: str, text: str, length: int = 30, most: int = MOST_CELLS, cells: int | None = None) -> DataFrame:
    """hash, key, ``at`` (first word) of every window that may be repeated: all that are, and few others."""
    src = docs.select(F.col(key), F.col(text).alias("__text")).filter(F.col("__text").isNotNull() & F.col(key).isNotNull())
    cells = cells or cells_for(src.agg(F.sum(F.octet_length("__text")).alias("n")).first().n or 0, length)
    if cells <= most:
        return _windowed(src, key, length, docs.sparkSession.sparkContext.broadcast(sketch(src.select("__text"), length, cells)))
    told = _repeated_minimizers(src, key, length).withColumnRenamed(key, "__key")
    return _windowed(src.join(told, F.col(key) == F.col("__key")).select(key, "__text", "m"), key, length, None, "m")


def shared_spans(docs: DataFrame, key: str, text: str, length: int = 30, most: int = MOST_CELLS, cells: int | None = None) -> DataFrame:
    """key, ``first_word``, ``last_word``: each longest unbroken stretch of words that lie in windows other records hold too.

    Words are counted from 0. A record given twice under one key is one record; records of different keys with the same
    text share it. Null, empty and shorter texts share nothing; texts are taken whole, however long. ``most`` is the largest
    sketch sent to the executors; ``cells`` sets its size, which is otherwise that for the size of the texts. Neither changes
    the result.

    Windows are told apart by 64-bit hashes: among n windows that came through, two different ones share a hash with a
    chance of about n^2 / 2^65.
    """
    met = materialise(candidates(docs, key, text, length, most, cells), "windows")  # for both sides of the join below
    # a window that a third of all records hold collapses before the shuffle: two keys are all that is kept of it
    several = met.groupBy("hash").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter(F.col("a") != F.col("b")).select("hash")
    places = met.join(several, "hash", "left_semi").groupBy(key).agg(F.array_sort(F.collect_set("at")).alias("p"))
    # of the sorted places, those further than a window from the one before begin a stretch
    begin = F.expr(f"filter(p, (x, i) -> i = 0 OR x - p[i - 1] > {length})")
    end = F.expr(f"filter(p, (x, i) -> i = size(p) - 1 OR p[i + 1] - x > {length})")
    spans = places.select(key, F.explode(F.arrays_zip(begin.alias("b"), end.alias("e"))).alias("s"))
    return spans.select(key, F.col("s.b").alias("first_word"), (F.col("s.e") + length - 1).alias("last_word"))


def shared_portion(docs: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """key, ``words``, ``shared_words``, ``share`` of every record, words as shared_spans tells them; a record without words has a null share."""
    src = docs.select(key, text)
    schema = T.StructType([src.schema[key], T.StructField("words", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                _, _, bounds = _parts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds).astype(np.int64))], names=schema.names)

    every = src.mapInArrow(count, schema).groupBy(key).agg(F.max("words").alias("words"))
    held = spans.groupBy(key).agg(F.sum(F.col("last_word") - F.col("first_word") + 1).alias("n"))
    out = every.join(held, key, "left").withColumn("shared_words", F.coalesce("n", F.lit(0)).cast("bigint"))
    return out.select(key, "words", "shared_words", F.when(F.col("words") > 0, F.col("shared_words") / F.col("words")).alias("share"))
