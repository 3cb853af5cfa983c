"""Finding text that was decoded with the wrong encoding, and restoring it.

Character n-gram models are counted over all clean records (those that no chain could be undone in). Every candidate chain
"encode with the charset it was wrongly read in, decode with its own" is tried on the words that hold other than ASCII
characters, also twice over; a chain's gain is the sum of what its words gain in likelihood, so a text garbled only in places
is found and restored in those places. The likeliest chain is accepted if it gains more than a margin validated on what all
records gain, as they are and garbled on purpose by every chain.

Counts live in hashed tables of fixed size, so what is sent to driver and executors does not grow with the data.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialise, tidied

#: Cells of each n-gram table.
CELLS = 1 << 18
#: Bins of gains, a quarter wide; what gains more is in the last.
BINS = 2000
#: Chains that may have been applied one after the other.
ROUNDS = 3
#: Values remembered by each Python worker.
REMEMBERED = 100_000
#: What a chain must gain at least, by kind: into UTF-8, whose sequences are telling, or into a charset of single bytes.
LEAST_MARGIN = (4.0, 4.0)
#: What a character costs that no clean record holds: a chain that makes such is hardly the one.
UNSEEN = 25.0
#: Characters that a chain of single bytes must change in a text: fewer are no evidence, whatever they gain.
LEAST_CHANGED = 3

# Charsets text is commonly misread in, and those it commonly is in.
READ_IN = ["cp1252", "latin_1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "iso8859_2", "iso8859_15", "cp1253", "cp1254", "mac_cyrillic"]
OWN = ["utf_8", "cp1251", "koi8_r", "cp866", "cp1252", "cp1250", "mac_roman", "cp437", "cp850", "iso8859_5", "mac_cyrillic"]


def _encoder(charset: str) -> dict[int, int]:
    """Character -> byte; a byte the charset leaves undefined is the control character of that number."""
    out: dict[int, int] = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(charset))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    return out


def _decoder(charset: str) -> dict[int, str]:
    return {b: chr(c) for c, b in _encoder(charset).items()}


_ENCODERS = {c: _encoder(c) for c in READ_IN}
_BACK = {a: {b: chr(c) for c, b in of.items()} for a, of in _ENCODERS.items()}
_DECODERS = {c: _decoder(c) for c in OWN if c != "utf_8"}
_BYTES = {own: {t: b for b, t in of.items()} for own, of in _DECODERS.items()}
CHAINS = [(a, b) for b in OWN for a in READ_IN if a != b]
#: Of every chain into single bytes, what each character was; control characters are no text.
_TABLES = {(a, b): {c: t for c, byte in _ENCODERS[a].items() if (t := _DECODERS[b].get(byte)) is not None and not "\x80" <= t < "\xa0"} for a, b in CHAINS if b != "utf_8"}
#: Chains by kind: into UTF-8, into a charset of single bytes.
KINDS = ([c for c in CHAINS if c[1] == "utf_8"], [c for c in CHAINS if c[1] != "utf_8"])
#: Charsets in which clean text hardly ever looks like UTF-8. (In cp866 Cyrillic words do.)
TELLING = [c for c in READ_IN if c != "cp866"]
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_OTHER = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]+")


@lru_cache(100_000)
def _fitting(chars: frozenset[str], pairs: bool, single: bool) -> list[tuple[str, str]]:
    """Chains that can have made a word with these other than ASCII characters; those of UTF-8 leave two or more side by side."""
    points = list(map(ord, chars))
    return [c for c in CHAINS if (pairs if c[1] == "utf_8" else single and all(x in _TABLES[c] for x in points))]


_PAIR = re.compile(r"[^\x00-\x7f]{2}")


def undo(word: str, chain: tuple[str, str]) -> str | None:
    """The word as it was before the chain, or None if the chain cannot have made it.

    For UTF-8 the sequences that are whole are decoded and the rest stays; for other charsets every character must fit.
    """
    read, own = chain
    if own != "utf_8":
        table = _TABLES[chain]
        if not all(ord(c) in table for c in word if c >= "\x80"):
            return None
        got = word.translate(table)
        return got if got != word else None
    to_byte = _ENCODERS[read]

    hit = False

    def part(m: re.Match) -> str:
        nonlocal hit
        run = m[0]
        raw = bytes(to_byte.get(ord(c), 0) for c in run)  # 0 stands for what the charset lacks and matches no sequence
        if not _UTF8.search(raw):
            return run
        out, at = [], 0
        for s in _UTF8.finditer(raw):
            out.append(run[at : s.start()])
            try:
                t = s[0].decode("utf-8")
                hit = True
            except UnicodeDecodeError:
                t = run[s.start() : s.end()]
            out.append(t)
            at = s.end()
        return "".join([*out, run[at:]])

    got = _RUN.sub(part, word)
    return got if hit else None


def garble(text: str, chain: tuple[str, str]) -> str | None:
    """The text as the chain garbles it: its own bytes read in the wrong charset."""
    read, own = chain
    try:
        raw = text.encode("utf-8") if own == "utf_8" else bytes(ord(c) if c < "\x80" else _BYTES[own][c] for c in text)
    except KeyError:
        return None
    back = _BACK[read]
    return "".join(chr(b) if b < 128 else back[b] for b in raw)


def looks_undoable(text: str) -> bool:
    """Whether some UTF-8 chain can be undone in the text, or a character was lost."""
    return "�" in text or _PAIR.search(text) is not None and any(undo(text, (read, "utf_8")) is not None for read in TELLING)


# -- the model ---------------------------------------------------------------------------------------------------------

_M = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _cells(*chars: np.ndarray) -> np.ndarray:
    h = np.zeros(len(chars[0]), np.uint64)
    for c, m in zip(chars, _M[: len(chars)], strict=True):
        h = (h ^ c.astype(np.uint64)) * np.uint64(m)
        h ^= h >> np.uint64(15)
    return (h % np.uint64(CELLS)).astype(np.int64)


def _cell(*chars: int) -> int:
    h = 0
    for c, m in zip(chars, _M, strict=False):
        h = ((h ^ c) * m) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 15
    return h % CELLS


def _framed(texts: list[str]) -> np.ndarray:
    """Code points, each word led by two spaces and the text closed by one: position i is predicted from i-2, i-1."""
    return np.frombuffer("".join(f"  {'  '.join(t.split(' '))} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(3 * CELLS, np.int64)
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t and (t.isascii() or not looks_undoable(t))]
        c = _framed(texts)
        if len(c) < 3:
            continue
        for n, grams in enumerate(((c,), (c[:-1], c[1:]), (c[:-2], c[1:-1], c[2:]))):
            counts[n * CELLS : (n + 1) * CELLS] += np.bincount(_cells(*grams), minlength=CELLS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cell", "n"])


class Model:
    """Trigrams, backing off to bigrams and single characters by Witten-Bell-like smoothing over hashed counts."""

    def __init__(self, counts: np.ndarray):
        self.one, self.two, self.three = (counts[i * CELLS : (i + 1) * CELLS] for i in range(3))
        self.total = max(1, int(self.one.sum()))
        self.known: dict[str, float] = {}
        self._one, self._two = lru_cache(200_000)(self._single), lru_cache(500_000)(self._double)

    def _single(self, c: str) -> tuple[float, float, float]:
        """(count of a character, its chance, what it costs if no clean record holds it)."""
        n = float(self.one[_cell(ord(c))])
        return n, (n + 0.01) / (self.total + 0.01 * CELLS), 0.0 if n or c < "\x80" else UNSEEN

    def _double(self, bc: str) -> tuple[float, float]:
        """(count of two characters, the chance of the second after the first)."""
        n = float(self.two[_cell(*map(ord, bc))])
        return n, (n + 2.0 * self._one(bc[1])[1]) / (self._one(bc[0])[0] + 2.0)

    def _p(self, gram: str) -> float:
        n = float(self.three[_cell(*map(ord, gram))])
        return math.log((n + 2.0 * self._two(gram[1:])[1]) / (self._two(gram[:2])[0] + 2.0)) - self._one(gram[2])[2]

    def score(self, word: str) -> float:
        """Log-likelihood of a word between spaces."""
        s, known, out = f"  {word} ", self.known, 0.0
        for i in range(len(s) - 2):
            g = s[i : i + 3]
            p = known.get(g)
            if p is None:
                if len(known) > 500_000:
                    known.clear()
                p = known[g] = self._p(g)
            out += p
        return out


def train(texts: DataFrame) -> np.ndarray:
    """n-gram counts over every clean record of the one string column of texts."""
    with tidied(texts.sparkSession):
        cells = texts.mapInArrow(_count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
        got = cells.toPandas()  # at most 3 * CELLS rows, whatever the size of texts
    counts = np.zeros(3 * CELLS, np.float32)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    return counts


class Restorer:
    """Restores texts under a model and a margin."""

    def __init__(self, counts: np.ndarray, margin: tuple[float, float] = LEAST_MARGIN):
        self.model, self.margin = Model(counts), margin
        self._gains, self._planted = lru_cache(REMEMBERED)(self._word_gains), lru_cache(REMEMBERED // 4)(self._word_planted)

    def _word_gains(self, word: str, single: bool) -> dict[tuple[str, str], tuple[float, str]]:
        """Of every chain that can have made the word, ``single`` ones included or not: what undoing it gains, and the word undone."""
        out, was, seen = {}, None, {}
        for chain in _fitting(frozenset(_OTHER.findall(word)), _PAIR.search(word) is not None, single):
            utf8 = chain[1] == "utf_8"
            got = undo(word, chain) if utf8 else word.translate(_TABLES[chain])
            if got is None or got == word:
                continue
            if got not in seen:
                if was is None:
                    was = self.model.score(word)
                # what is garbled twice may look no better when undone once
                further = {t for read in READ_IN if (t := undo(got, (read, "utf_8"))) is not None} if utf8 and _PAIR.search(got) else ()
                seen[got] = max(map(self.model.score, {got, *further})) - was
            if seen[got] > 0:
                out[chain] = (seen[got], got)
        return out

    def _word_planted(self, word: str, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every chain of the kind, when it has garbled the word: what undoing it gains, the characters that count as changed back, and
        whether there is anything to undo. A chain that cannot garble the word gains NaN."""
        chains = KINDS[kind]
        gain, changed, differs, was = np.zeros(len(chains)), np.zeros(len(chains)), np.zeros(len(chains), bool), self.model.score(word)
        for i, chain in enumerate(chains):
            g = garble(word, chain)
            if g is None:
                gain[i] = np.nan
            elif g != word:
                differs[i] = True
                gain[i] = max(0.0, was - self.model.score(g))
                if gain[i] > 0:
                    changed[i] = sum(a != b for a, b in zip(word, g, strict=True)) if kind else LEAST_CHANGED
        return gain, changed, differs

    def planted(self, text: str, kind: int) -> np.ndarray:
        """What undoing gains in the text as each chain of the kind garbles it, of all chains that can: none if too few characters change."""
        told = [self._planted(w, kind) for w in text.split(" ") if not w.isascii()]
        gain, changed, differs = (sum(x) for x in zip(*told, strict=True))
        return np.where(changed >= LEAST_CHANGED, gain, 0.0)[(differs > 0) & ~np.isnan(gain)]

    def once(self, text: str, kinds: tuple[int, ...] = (0, 1)) -> tuple[float, tuple[str, str] | None, str]:
        """(gain beyond its kind's margin, chain, text undone) of the likeliest chain."""
        total: dict[tuple[str, str], float] = {}
        changed: dict[tuple[str, str], int] = {}
        # too few characters for a chain of single bytes, and none side by side as UTF-8 leaves them: nothing can be undone
        single = len(_OTHER.findall(text)) >= LEAST_CHANGED
        if not single and not _PAIR.search(text):
            return 0.0, None, text
        words = text.split(" ")
        for w in words:
            if not w.isascii():
                for chain, (gain, got) in self._gains(w, single).items():
                    if (kind := int(chain[1] != "utf_8")) in kinds:
                        total[chain] = total.get(chain, -self.margin[kind]) + gain
                        changed[chain] = changed.get(chain, 0) + (sum(a != b for a, b in zip(w, got, strict=True)) if kind else LEAST_CHANGED)
        total = {c: g for c, g in total.items() if changed[c] >= LEAST_CHANGED}
        if not total:
            return 0.0, None, text
        chain = max(total, key=lambda c: (total[c], -CHAINS.index(c)))
        undone = " ".join(w if w.isascii() else self._gains(w, single).get(chain, (0, w))[1] for w in words)
        return total[chain], chain, undone

    def __call__(self, text: str) -> tuple[str, str, float] | None:
        """(text restored, chains, gain), or None for a clean text. A text that lost characters is restored as far as it goes."""
        at, chains, gained = text, [], 0.0
        for _ in range(ROUNDS):
            gain, chain, undone = self.once(at)
            if chain is None or gain <= 0:
                break
            at, gained = undone, gained + gain
            chains.append(f"{chain[0]}>{chain[1]}")
        if chains or "�" in text:
            return at, ",".join(chains) or "lost", gained
        return None


def validated_margin(gains: np.ndarray, planted: Callable[[list[int]], np.ndarray]) -> tuple[float, float]:
    """(margin of UTF-8 chains, margin of single-byte chains).

    ``gains`` has for either kind the numbers of all distinct records by gain; ``planted`` gives those numbers for the kinds it is asked
    for, of all distinct records garbled by every chain that can. A margin is twice the gain that 1 % of all records exceed, but no
    more than what 99 % of the garbled ones gain: so it cannot rise with the share of garbled records. None is below LEAST_MARGIN, so
    records are garbled only where the gains would make it more.
    """
    margins = [2 * float(np.searchsorted(sums, 0.99 * sums[-1])) / 4 if (sums := np.cumsum(gains[kind]))[-1] else 0.0 for kind in (0, 1)]
    if kinds := [kind for kind in (0, 1) if margins[kind] > LEAST_MARGIN[kind]]:
        told = planted(kinds)
        for kind in kinds:
            sums = np.cumsum(told[kind])
            if sums[-1]:
                margins[kind] = min(margins[kind], float(np.searchsorted(sums, sums[-1] // 100, side="right")) / 4)
    return max(LEAST_MARGIN[0], margins[0]), max(LEAST_MARGIN[1], margins[1])


def _gain_counts(shared, kinds: list[int], garbled: bool):
    """Numbers of records by gain, as they are or garbled by every chain; the bins of the former are rounded up, of the latter down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, told = restorer(shared, (0.0, 0.0)), np.zeros((2, BINS), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not looks_undoable(t):
                    for kind in kinds:
                        at = np.floor(4 * r.planted(t, kind)) if garbled else [math.ceil(4 * max(0.0, r.once(t, (kind,))[0]))]
                        np.add.at(told[kind], np.minimum(BINS - 1, at).astype(np.int64), 1)
        kind, place = np.nonzero(told)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(told[kind, place])], names=["kind", "bin", "n"])

    return run


_restorers: dict[int, Restorer] = {}


def restorer(shared: _Shared, margin: tuple[float, float]) -> Restorer:
    """Kept by each worker, with what it has looked up, which no margin changes."""
    if shared.id not in _restorers:
        _restorers.clear()
        _restorers[shared.id] = Restorer(shared.value, margin)
    _restorers[shared.id].margin = margin
    return _restorers[shared.id]


def _restore(shared, margin: tuple[float, float], keys: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = restorer(shared, margin)
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            told = [(i, got) for i, t in enumerate(texts) if t and not t.isascii() and (got := r(t)) is not None]
            at = batch.take(pa.array([i for i, _ in told], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*at.columns, pa.array([g[0] for _, g in told], pa.string()), pa.array([g[1] for _, g in told], pa.string()), pa.array([g[2] for _, g in told], pa.float64())],
                names=names,
            )

    return run


class Fitted(tuple):
    """(counts, margins), with the counts as the executors have them."""

    shared: _Shared


def fit(texts: DataFrame) -> Fitted:
    """Counts over all rows of the one string column, and margins validated on the gains of all of them that are not ASCII."""
    texts = texts.toDF("t").filter(F.col("t").isNotNull())
    counts = train(texts)
    shared = _Shared(texts.sparkSession.sparkContext.broadcast(counts))
    other = materialise(texts.filter(F.col("t").rlike(r"[^\x00-\x7f]")).distinct(), "texts")

    def counted(kinds: list[int], garbled: bool) -> np.ndarray:
        out = np.zeros((2, BINS))
        for r in other.mapInArrow(_gain_counts(shared, kinds, garbled), "kind int, bin int, n bigint").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():
            out[r.kind, r.bin] = r.n
        return out

    out = Fitted((counts, validated_margin(counted([0, 1], False), lambda kinds: counted(kinds, True))))
    out.shared = shared
    discard(other)
    return out


def restore(df: DataFrame, text: str, keys: list[str], model: Fitted) -> DataFrame:
    """The garbled records of df only: the keys, ``text`` as it is, ``restored``, ``chains`` and ``gain``
    (likelihood gained beyond the margins).

    ``chains`` names what was undone, first to last, as ``read in>own``, or is ``lost`` if characters were lost (U+FFFD)
    and nothing could be undone. Null, empty and ASCII texts are clean; repeated rows are reported as often; a text of any
    length is judged whole; columns of df other than keys and text are not carried.
    """
    clash = {"text", "restored", "chains", "gain"} & set(keys)
    if clash:
        raise ValueError(f"keys are named like columns of the result: {sorted(clash)}")
    src = df.select(*keys, F.col(text).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    schema = T.StructType([src.schema[c] for c in keys] + [T.StructField("text", T.StringType()), T.StructField("restored", T.StringType()), T.StructField("chains", T.StringType()), T.StructField("gain", T.DoubleType())])
    return src.mapInArrow(_restore(model.shared, model[1], keys, schema.names), schema)


class _Shared:
    """A broadcast and its id, by which a worker keeps what it built from it."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    @property
    def value(self):
        return self.broadcast.value
