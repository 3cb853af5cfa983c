"""Passages of evaluation texts within documents: q-gram lemma filtering in diagonal bands, verified by banded alignment.

Both sides become words in one form, joined by single spaces. An edit is a word replaced, inserted or dropped. A stretch of an
item that a document holds within e edits is e+1 pieces at most, which together share at least L - (e+1)(q-1) q-grams with it,
L being their characters, all within a band of diagonals. So q-grams of a document that the items also have are counted
by overlapping bands of diagonals; bands that reach the item's bound are verified by a banded alignment of words.

The q-grams of items of a checked size go to every executor, and the documents are read without a shuffle, once for so many items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of items that are sent to the executors together; more items take so many more passes.
WHOLE = 20_000_000
Q = 12
#: Characters, its space included, by which an edit may move what follows: of a word inserted or dropped, or by which a replaced one differs.
WORD = 13
#: Bands that are aligned together.
BANDS = 1024
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Unbroken runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


def _grams(text: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram of a code-point array."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # polynomial hash, doubling the span: h of 2s characters from two of s
    h = text.astype(np.uint64) * _MIX
    span = 1
    covered, at, left, out = 0, h, q, None
    while left:
        if left & 1:
            part = at[covered : covered + n]
            out = part.copy() if out is None else (out ^ (out >> np.uint64(29))) * _MIX + part
            covered += span
        left >>= 1
        if left:
            at = (at[: len(at) - span] ^ (at[: len(at) - span] >> np.uint64(31))) * _MIX + at[span:]
            span *= 2
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Index:
    """q-grams of all items, laid one after the other."""

    def __init__(self, items: list[tuple[object, str]], least_words: int, edits: int):
        self.ids = [i for i, _ in items]
        self.words = [words(t or "") for _, t in items]
        self.word_starts = [np.cumsum([0, *(len(x) + 1 for x in w)])[:-1] for w in self.words]
        self.ids_of: dict[str, int] = {}
        self.word_ids = [np.array([self.ids_of.setdefault(x, len(self.ids_of)) for x in w], np.int64) for w in self.words]
        self.least, self.edits = least_words, edits
        texts = [" ".join(w) for w in self.words]
        # of each item: the fewest characters that so many words, less the edits between them, can have
        fewest = [self._fewest([len(x) for x in w]) for w in self.words]
        shortest = min((x for x in fewest if x), default=0)
        self.q = max(1, min(Q, shortest // (edits + 1)))
        self.bounds = np.array([max(1, x - (edits + 1) * (self.q - 1)) if x else 1 << 40 for x in fewest], np.int64)
        self.bound = int(self.bounds.min(initial=1 << 40))
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        all_points = _points("\n".join(texts))
        grams = _grams(all_points, self.q)
        within = np.ones(len(grams), bool)  # q-grams that lie within one item
        for e in np.flatnonzero(all_points == 10):
            within[max(0, e - self.q + 1) : e + 1] = False
        at = np.flatnonzero(within)
        order = np.argsort(grams[at], kind="stable")
        self.grams, self.at = grams[at][order], at[order]
        self.item = np.searchsorted(self.starts, self.at, "right") - 1
        self.seen = np.zeros(1 << 22, bool)  # which q-grams may be among them, by their leading bits
        self.seen[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def _fewest(self, sizes: list[int]) -> int:
        """The fewest characters of ``least`` words, with the spaces within their pieces, of a stretch with ``edits`` more; 0 for shorter items."""
        wide = min(len(sizes), self.least + self.edits)
        if len(sizes) < self.least:
            return 0
        words = min(sum(sorted(sizes[i : i + wide])[: self.least]) for i in range(len(sizes) - wide + 1))
        return max(1, words + self.least - self.edits - 1)

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, q-grams) of a code-point array that the items have."""
        grams = _grams(points, self.q)
        spots = np.flatnonzero(self.seen[(grams >> np.uint64(42)).astype(np.int64)])
        if not len(spots):
            return spots, grams[:0]
        mine = grams[spots]
        lo = np.minimum(np.searchsorted(self.grams, mine, "left"), len(self.grams) - 1)
        sure = self.grams[lo] == mine
        return spots[sure], mine[sure]

    def bands(self, spots: np.ndarray, grams: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of the bands that reach the bound."""
        if len(spots) < self.bound:
            return []
        lo = np.searchsorted(self.grams, grams, "left")
        n = np.searchsorted(self.grams, grams, "right") - lo
        k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, diagonal = self.item[k], np.repeat(spots, n) - (self.at[k] - self.starts[self.item[k]])
        # bands two widths wide begin every width: a region within e edits lies whole in one of them
        width = max(1, 2 * WORD * self.edits)
        shift = 1 << 40
        band = np.concatenate([diagonal // width, diagonal // width - 1]) if self.edits else diagonal
        key = (np.concatenate([item, item]) if self.edits else item).astype(np.int64) * shift * 2 + band + shift
        keys, counts = np.unique(key, return_counts=True)
        out = []
        for x in keys[counts >= self.bounds[keys // (shift * 2)]].tolist():
            i, b = divmod(x, shift * 2)
            b -= shift
            out.append((i, b * width, (b + 2) * width - 1) if self.edits else (i, b, b))
        return out

    def longest(self, bands: list[tuple[int, int, int, int]], words: list[np.ndarray], starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(longest runs of equal words, most words aligned within the edits) of (item, document, first, last diagonal) bands.

        All bands advance together, a word of their items at a time, over the words of their documents that lie within the
        band; a cell holds the equal words of the longest stretch that ends there with at most 0, 1, .. edits.
        """
        item, doc = [np.array([b[k] for b in bands]) for k in (0, 1)]
        rows = max(len(self.words[i]) for i in item)
        own = np.full((rows, len(bands)), -1, np.int64)
        first, last = np.zeros((rows, len(bands)), np.int64), np.zeros((rows, len(bands)), np.int64)
        for n, (i, d, lo, hi) in enumerate(bands):
            at = self.word_starts[i]
            own[: len(at), n] = self.word_ids[i]
            first[: len(at), n] = np.searchsorted(starts[d], at + lo)
            last[: len(at), n] = np.searchsorted(starts[d], at + hi, "right")
            first[len(at) :, n] = last[len(at) :, n] = first[len(at) - 1, n]  # no cells beyond its end
        width = int((last - first).max(initial=0))
        place = np.arange(width)
        ends = np.cumsum([len(w) for w in words])
        text = np.concatenate([*words, np.full(width + 1, -2)])
        begin = (ends - [len(w) for w in words])[doc]
        best_run, best = np.zeros(len(bands), np.int32), np.zeros(len(bands), np.int32)
        # a column of zeros behind the cells stands for all outside
        above = [np.zeros((len(bands), width + 1), np.int32) for _ in range(self.edits + 1)]
        line = np.arange(len(bands))[:, None] * (width + 1)
        for i in range(rows):
            shift = first[i] - first[i - 1] if i else first[i]
            up = place + shift[:, None]
            diagonal = line + np.where((up > 0) & (up <= width), up - 1, width)
            up = line + np.minimum(up, width)
            within = place < (last[i] - first[i])[:, None]
            same = within & (text[np.minimum(begin + first[i], len(text) - width - 1)[:, None] + place] == own[i][:, None])
            row: list[np.ndarray] = []
            before = None  # the cells diagonally before, with one edit less
            for e, cells in enumerate(above):
                at = cells.ravel().take(diagonal)
                new = np.zeros((len(bands), width + 1), np.int32)
                now = new[:, :width]
                np.multiply(at + 1, same, out=now)
                if e:  # replaced, dropped, inserted
                    np.maximum(now, before, out=now)
                    np.maximum(now, above[e - 1].ravel().take(up), out=now)
                    np.maximum(now[:, 1:], row[e - 1][:, : width - 1], out=now[:, 1:])
                    now *= within
                before = at
                row.append(new)
            above = row
            best_run, best = np.maximum(best_run, row[0].max(1)), np.maximum(best, row[-1].max(1))
        return best_run, best

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, run, aligned) wherever a text aligns at least ``least`` words with an item along one band."""
        if not len(self.grams):
            return
        joined = [" ".join(_WORD.findall(t.lower())) if t else "" for t in texts]
        ends = np.cumsum([len(t) + 1 for t in joined])
        spots, grams = self.hits(_points("\n".join(joined)))  # no q-gram of an item holds a line break
        bounds = np.searchsorted(spots, np.concatenate([[0], ends]))
        bands, held, words, starts = [], [], [], []
        for n in np.flatnonzero(np.diff(bounds) >= self.bound).tolist():
            part = slice(bounds[n], bounds[n + 1])
            told = self.bands(spots[part] - (ends[n] - len(joined[n]) - 1), grams[part])
            if told:
                doc = joined[n].split(" ")
                bands += [(i, len(held), a, b) for i, a, b in told]
                held.append(n)
                words.append(np.array([self.ids_of.get(w, -2) for w in doc]))
                starts.append(np.cumsum([0, *(len(w) + 1 for w in doc[:-1])]))
        bands.sort(key=lambda b: len(self.words[b[0]]))
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for k in range(0, len(bands), BANDS):
            some = bands[k : k + BANDS]
            for (i, d, _, _), run, aligned in zip(some, *(x.tolist() for x in self.longest(some, words, starts)), strict=True):
                if aligned >= self.least:
                    was = out.get((held[d], i), (0, 0))
                    out[held[d], i] = (max(run, was[0]), max(aligned, was[1]))
        for (n, i), (run, aligned) in out.items():
            yield n, i, run, aligned


def leaked(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, least_words: int = 12, edits: int = 0, most: int = WHOLE) -> DataFrame:
    """item, document, ``run`` (longest run of equal words), ``aligned`` (equal words of a stretch with at most ``edits`` words
    replaced, inserted or dropped, each moving what follows by at most WORD characters).

    A pair comes out if it aligns at least ``least_words`` words; with ``edits`` of 0 it holds them in an unbroken run. Null
    and empty texts hold nothing, texts shorter than ``least_words`` words neither; a document given twice is reported twice.
    Texts are judged whole, however long. Further columns are not carried. Items of more than ``most`` characters together are
    taken in parts, each with its own pass over the documents.
    """
    held = items.select(item_key, item_text).dropDuplicates([item_key])
    size = held.selectExpr(f"coalesce(sum(length(`{item_text}`)), 0) AS n").first().n
    parts = max(1, -(-size // most))
    if parts > 1:
        held = held.withColumn("__part", F.pmod(F.xxhash64(item_key), F.lit(parts)))
        return reduce(DataFrame.unionByName, [_leaked(docs, doc_key, text, held.filter(F.col("__part") == p).drop("__part"), item_key, item_text, least_words, edits) for p in range(parts)])
    return _leaked(docs, doc_key, text, held, item_key, item_text, least_words, edits)


def _leaked(docs: DataFrame, doc_key: str, text: str, held: DataFrame, item_key: str, item_text: str, least_words: int, edits: int) -> DataFrame:
    index = Index([(r[0], r[1]) for r in held.sort(item_key).collect()], least_words, edits)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    src = docs.select(doc_key, text)
    schema = T.StructType([T.StructField(item_key, held.schema[item_key].dataType), T.StructField(doc_key, src.schema[doc_key].dataType), T.StructField("run", T.IntegerType()), T.StructField("aligned", T.IntegerType())])

    kinds = pa.schema([("item", to_arrow_type(schema[0].dataType)), ("doc", to_arrow_type(schema[1].dataType)), ("run", pa.int32()), ("aligned", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # some hundred documents at a time bound the memory
                part = batch.slice(at, 512)
                got = list(idx.found(part.column(1).to_pylist()))
                told = [pa.array([idx.ids[i] for _, i, _, _ in got], kinds.field(0).type), part.column(0).take(pa.array([n for n, *_ in got], pa.int64()))]
                yield pa.RecordBatch.from_arrays([*told, *[pa.array([g[k] for g in got], pa.int32()) for k in (2, 3)]], names=schema.names)

    return src.mapInArrow(run, schema)
