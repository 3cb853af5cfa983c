"""Bringing text to one form: look-alike letters, compatibility forms, parted accents, unusual spaces, invisible characters.

A batch of Arrow text becomes one numpy array of code points. Lookup tables gathered by code point replace, expand and drop
characters, offsets carry the expansion, and marks are composed by a sorted table of (letter, mark) pairs. No function is
called per string or per character.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of another script that look like a Latin letter, and the letter they look like.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY аa вв еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ѵv"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa οo νv ρp υu ιi κκ ϲc ϳj"
#: Cyrillic letters a Latin letter may stand for.
LATIN_IN_CYRILLIC = "AА BВ EЕ SЅ IІ JЈ KК MМ HН OО PР CС TТ YУ XХ aа eе sѕ iі jј oо pр cс yу xх"
#: Hyphens, dashes and apostrophes typed for the ASCII ones.
MARKS = "‐- ‑- ‒- –- —- ―- −- ﹣- －- ’' ‘' ʼ' ＇' ′'"

LIMIT = 0x30000  # code points above are private use, tags and the like; they stay
_SCRIPTS = {"LATIN": 1, "CYRILLIC": 2, "GREEK": 3, "DEVANAGARI": 4}

KINDS = ["letter", "form", "accent", "space", "invisible"]


@lru_cache(1)
def _tables() -> dict[str, np.ndarray]:
    kind = np.zeros(LIMIT, np.int8)  # 1 + index into KINDS of what the character is, by itself
    length = np.ones(LIMIT, np.int8)
    start = np.arange(LIMIT, dtype=np.int64)  # where its replacement lies in pool
    pool = list(range(LIMIT))
    script = np.zeros(LIMIT, np.int8)
    mark = np.zeros(LIMIT, bool)

    def put(c: int, to: str, what: int) -> None:
        kind[c], length[c], start[c] = what, len(to), len(pool)
        pool.extend(map(ord, to))

    pairs: list[tuple[int, int, int]] = []
    for c in range(0x80, LIMIT):
        s = chr(c)
        cat = unicodedata.category(s)
        if cat in ("Cn", "Co", "Cs"):
            continue
        whole = unicodedata.decomposition(s)
        if whole and whole[0] != "<":
            parts = whole.split()
            if len(parts) == 2 and unicodedata.normalize("NFC", s) == s:
                pairs.append((int(parts[0], 16), int(parts[1], 16), c))
        name = unicodedata.name(s, "")
        script[c] = next((v for k, v in _SCRIPTS.items() if name.startswith(k)), 0) if cat[0] == "L" else 0
        mark[c] = cat == "Mn" and (0x300 <= c < 0x370 or 0x1AB0 <= c < 0x1B00 or 0x1DC0 <= c < 0x1E00 or 0x20D0 <= c < 0x2100 or 0xFE20 <= c < 0xFE30)
        if cat in ("Zs", "Zl", "Zp"):
            put(c, " ", 4)
        elif cat == "Cf" or 0xFE00 <= c <= 0xFE0F or c in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x2800):
            put(c, "", 5)
        elif whole.startswith("<") and cat[0] in "LNPSM" and not (cat[0] == "S" and c < 0x2000) and c not in (0xAA, 0xBA, 0xB5):
            to = unicodedata.normalize("NFKC", s)
            if to != s:
                put(c, to, 2)
                script[c] = script[ord(to[0])] if to[0].isalpha() and ord(to[0]) >= 0x80 else int(to[0].isascii() and to[0].isalpha())
    for c in [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]:
        script[c] = 1
    for x in MARKS.split():
        put(ord(x[0]), x[1], 2)
    like = {}
    for name, text, home in (("to_latin", f"{CYRILLIC} {GREEK}", 0), ("to_cyrillic", LATIN_IN_CYRILLIC, 0)):
        table = np.arange(LIMIT)
        for x in text.split():
            table[ord(x[0])] = ord(x[1])
        like[name] = table + home
    order = sorted((a << 21 | b, c) for a, b, c in pairs)
    return {
        "kind": kind, "length": length, "start": start, "pool": np.array(pool), "script": script, "mark": mark, **like,
        "pair": np.array([k for k, _ in order]), "composed": np.array([c for _, c in order]),
    }


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a null-free array, and the bounds of its strings."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b""
    cps = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return cps, np.concatenate([[0], np.cumsum(first)])[offsets - offsets[0]]


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of flags within each string."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def unify_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(texts in one form, kinds found) of a null-free string array; the kinds are bits in the order of KINDS."""
    t = _tables()
    if not len(texts):
        return texts, np.zeros(0, np.int64)
    cps, bounds = _code_points(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    low = np.minimum(cps, LIMIT - 1)
    script, kind = t["script"][low], t["kind"][low].copy()
    script[cps >= LIMIT], kind[cps >= LIMIT] = 0, 0

    # a joiner between Devanagari characters belongs there
    deva = (cps >= 0x900) & (cps < 0x980)
    before = np.concatenate([[False], deva[:-1]])
    joins = ((cps == 0x200C) | (cps == 0x200D)) & before
    after = np.concatenate([deva[1:], [False]])
    kind[joins & after] = 0

    # the script of a name is that of most of its letters that have no look-alike, or, if there are none, of most letters
    to_latin, to_cyrillic = t["to_latin"][low], t["to_cyrillic"][low]
    sure = np.where(script == 1, to_cyrillic == low, np.where((script == 2) | (script == 3), to_latin == low, script > 0))
    counts = np.stack([(_sums((script == s) & sure, bounds) << 32) + _sums(script == s, bounds) for s in range(1, 5)])
    home = np.where(counts.max(0) > 0, counts.argmax(0) + 1, 0)[row] if len(row) else np.zeros(0, np.int64)
    swap = np.where((home == 1) & ((script == 2) | (script == 3)), to_latin, np.where((home == 2) & (script == 1), to_cyrillic, low))
    swap = np.where(cps < LIMIT, swap, cps)
    like = (swap != cps) & (kind == 0)
    mark = t["mark"][low] & (cps < LIMIT)

    bits = np.zeros(len(texts), np.int64)
    for i, hit in enumerate((like, kind == 2, mark, kind == 4, kind == 5)):
        bits |= (_sums(hit, bounds) > 0).astype(np.int64) << i

    # gather the replacements
    replaced = kind > 0
    n = np.where(replaced, t["length"][low], 1).astype(np.int64)
    at = np.repeat(np.where(replaced, t["start"][low], 0), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = np.where(np.repeat(replaced, n), t["pool"][at + within], np.repeat(swap, n))
    row = np.repeat(row, n)

    # compose marks with the letter before them, one mark a round
    while len(out) > 1:
        key = out[:-1] << 21 | out[1:]
        spot = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        fits = (t["pair"][spot] == key) & (row[:-1] == row[1:]) & t["mark"][np.minimum(out[1:], LIMIT - 1)]
        fits[1:] &= ~fits[:-1]
        if not fits.any():
            break
        i = np.flatnonzero(fits)
        out = out.copy()
        out[i] = t["composed"][spot[i]]
        stay = np.ones(len(out), bool)
        stay[i + 1] = False
        out, row = out[stay], row[stay]

    # spaces: one between words, none at the ends
    space = (out == 32) | ((out >= 9) & (out <= 13))
    out = np.where(space, 32, out)
    last = np.concatenate([row[1:] != row[:-1], [True]]) if len(row) else np.zeros(0, bool)
    lead = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    stay = ~(space & (lead | np.concatenate([[False], space[:-1]]))) if len(row) else np.zeros(0, bool)
    out, row, space = out[stay], row[stay], space[stay]
    last = np.concatenate([row[1:] != row[:-1], [True]]) if len(row) else last[:0]
    stay = ~(space & last)
    out, row = out[stay], row[stay]

    return _strings(out, np.searchsorted(row, np.arange(len(texts) + 1))), bits


def _strings(cps: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow string array of code points between bounds."""
    raw = cps.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    size = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(size)])[bounds].astype(np.int32)
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw))


def _run(keys: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(keys).cast(pa.string())
            form, bits = unify_array(text.fill_null(""))
            form = pa.compute.if_else(text.is_null(), pa.scalar(None, pa.string()), form)
            yield pa.RecordBatch.from_arrays([*batch.columns, form, pa.array(bits, pa.int64())], names=names)

    return run


def unify(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Every row of df: the keys, ``text`` as it is, ``unified`` and ``kinds`` (array of KINDS that the text held).

    Letters of another script are replaced only in a text whose own script is another: a name wholly in one script stays.
    Accents composed with their letter stay; a joiner within a Devanagari word stays; runs of spaces become one and those
    at the ends go, which by itself is of no kind. Null gives null and no kinds, an empty text stays empty, repeated rows
    stay repeated; columns of df other than keys and text are not carried.
    """
    clash = {"text", "unified", "kinds"} & set(keys)
    if clash:
        raise ValueError(f"keys are named like columns of the result: {sorted(clash)}")
    src = df.select(*keys, F.col(text).alias("text"))
    schema = T.StructType([src.schema[c] for c in keys] + [T.StructField("text", T.StringType()), T.StructField("unified", T.StringType()), T.StructField("__bits", T.LongType())])
    out = src.mapInArrow(_run(len(keys), schema.names), schema)
    kinds = F.array_compact(F.array(*[F.when(F.col("__bits").bitwiseAND(1 << i) != 0, F.lit(k)) for i, k in enumerate(KINDS)]))
    return out.select(*keys, "text", "unified", kinds.alias("kinds"))
