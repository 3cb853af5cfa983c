"""Name functions: native column expressions, and Arrow UDFs where Spark has no function."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Titles before names, suffixes behind them, scripts with their ranges, and languages written in them.
HONORIFICS = [
    "mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "dame", "lord", "lady", "rev", "reverend", "hon", "capt", "sgt", "shri", "smt",
    "sri", "pandit", "ustad", "maestro",
]
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "phd", "md", "esq", "obe", "mbe", "cbe"]
SCRIPTS = {
    "devanagari": (0x0900, 0x097F), "bengali": (0x0980, 0x09FF), "gurmukhi": (0x0A00, 0x0A7F), "gujarati": (0x0A80, 0x0AFF), "tamil": (0x0B80, 0x0BFF),
    "telugu": (0x0C00, 0x0C7F), "kannada": (0x0C80, 0x0CFF), "malayalam": (0x0D00, 0x0D7F), "arabic": (0x0600, 0x06FF), "hebrew": (0x0590, 0x05FF),
    "cyrillic": (0x0400, 0x04FF), "greek": (0x0370, 0x03FF), "hangul": (0xAC00, 0xD7AF), "hiragana": (0x3040, 0x309F), "katakana": (0x30A0, 0x30FF),
    "cjk": (0x4E00, 0x9FFF), "thai": (0x0E00, 0x0E7F),
}
SCRIPT_LANGUAGES = {
    "devanagari": ["hi", "mr", "ne", "sa"], "bengali": ["bn"], "gurmukhi": ["pa"], "gujarati": ["gu"], "tamil": ["ta"], "telugu": ["te"], "kannada": ["kn"],
    "malayalam": ["ml"], "arabic": ["ar", "fa", "ur"], "hebrew": ["he"], "cyrillic": ["ru", "uk", "bg", "sr"], "greek": ["el"], "hangul": ["ko"],
    "hiragana": ["ja"], "katakana": ["ja"], "cjk": ["zh", "ja"], "thai": ["th"], "latin": ["en"],
}
LABEL_FLOOR = 0.62
TRANSLITERATED_MOST = 0.75


@F.pandas_udf(T.StringType())
def _strip_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def strip_marks(s: Column) -> Column:
    """Compatibility forms without combining marks. For ASCII text use the text itself: a UDF within ``when`` runs on all rows."""
    return _strip_marks(s)


def normalize_stripped(s: Column) -> Column:
    """The normal form of a name that has no marks (or had them stripped)."""
    s = F.regexp_replace(F.lower(s), "&", " and ")
    s = F.regexp_replace(s, r"([a-z])\.", "$1 ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_\s]+", " "), r"\s+", " "))
    s = F.regexp_replace(s, rf"^(?:(?:{'|'.join(HONORIFICS)})(?: |$))+", "")
    return F.regexp_replace(s, rf"(?:(?:^| )(?:{'|'.join(SUFFIXES)}))+$", "")


def normalize(s: Column) -> Column:
    return normalize_stripped(strip_marks(s))


def name_tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda x: x != "")


def initials_form(normal: Column) -> Column:
    """All words but the last as initials; a single word as it is."""
    t = name_tokens(normal)
    n = F.size(t)
    short = F.transform(F.slice(t, 1, F.greatest(n - 1, F.lit(1))), lambda x: F.substring(x, 1, 1))
    return F.when(n > 1, F.array_join(F.concat(short, F.slice(t, n, 1)), " ")).otherwise(F.array_join(t, " "))


def variants(name: Column, stripped: Column, normal: Column, transliterated: Column | None = None, most: int = 10) -> Column:
    """Spellings to look a name up by, the closest first, each once whatever its case.

    The name itself, without marks, normal, with initials, first and last word, leading initials drawn together, first name in
    front of a comma; of a name in another script its transliteration, if one is given.
    """
    t = name_tokens(normal)
    n = F.size(t)
    first_last = F.when(n > 1, F.concat_ws(" ", F.element_at(t, 1), F.element_at(t, -1)))
    lead = F.array_join(F.filter(F.slice(t, 1, F.greatest(n - 1, F.lit(1))), lambda x: F.length(x) == 1), "")
    drawn = F.when((n > 1) & (F.length(lead) > 1), F.concat_ws(" ", lead, F.element_at(t, -1)))
    front, back = F.trim(F.regexp_extract(name, r"(?s)^([^,]*),", 1)), F.trim(F.regexp_extract(name, r"(?s)^[^,]*,(.*)$", 1))
    flipped = F.when((n > 1) & (front != "") & (back != ""), F.concat_ws(" ", back, front))
    told = [F.trim(name), F.trim(stripped), normal, F.when(n > 1, initials_form(normal)), first_last, drawn, flipped]
    if transliterated is not None:
        told.append(F.when((script_of(name) != "latin") & (transliterated != name) & transliterated.rlike("[a-zA-Z]{3}"), normalize_stripped(transliterated)))
    found = F.filter(F.array_compact(F.array(*told)), lambda x: x != "")
    lower = F.transform(found, F.lower)
    return F.slice(F.filter(found, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1), 1, most)


def slug(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets, 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def _letters(first: int, last: int) -> str:
    return rf"[\x{{{first:X}}}-\x{{{last:X}}}&&\p{{L}}]"


def script_of(s: Column) -> Column:
    """The script of most letters; among equal ones that met first; latin for letters of no listed script and a text without letters."""
    classes = {k: _letters(*r) for k, r in SCRIPTS.items()}
    listed = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in SCRIPTS.values())
    classes["latin"] = rf"[\p{{L}}&&[^{listed}]]"
    counts = [F.struct(F.length(F.regexp_replace(s, f"[^{c}]", "")).alias("n"), (-F.regexp_instr(s, F.lit(c))).alias("at"), F.lit(k).alias("script")) for k, c in classes.items()]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best["script"]).otherwise(F.lit("latin"))


def search_languages(s: Column) -> Column:
    """Languages written in the name's script, and English."""
    table = F.create_map(*[x for k, v in SCRIPT_LANGUAGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_union(table[script_of(s)], F.array(F.lit("en")))


def languages_for(s: Column, country: Column, spoken: dict[str, list[str]], fixed: list[str] | None = None, most: int = 3) -> Column:
    """Editions to search for a person: the fixed ones if there are any, else those of the script, of the country and English."""
    if fixed:
        return F.array(*map(F.lit, fixed[:most]))
    table = F.create_map(*[x for k, v in spoken.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    there = F.coalesce(F.try_element_at(table, F.coalesce(country, F.lit(""))), F.array().cast("array<string>"))
    return F.slice(F.array_union(F.array_union(search_languages(s), there), F.array(F.lit("en"))), 1, most)


def name_in_title(name: Column, title: Column) -> Column:
    return F.coalesce(F.contains(slug(F.coalesce(title, F.lit(""))), slug(name)), F.lit(False))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings; null if either is."""
    known: dict[tuple[str, str], float] = {}

    def ratio(x: str, y: str) -> float:
        if (x, y) not in known:
            known[x, y] = difflib.SequenceMatcher(None, x, y).ratio()
        return known[x, y]

    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _tier(score, how: str) -> Column:
    return F.struct((F.lit(score) if isinstance(score, float) else score).alias("score"), F.lit(how).alias("how"))


def label_tier(query: Column, label: Column, nq: Column, nl: Column) -> Column:
    """struct(score, how) of the tiers that need no fuzzy comparison; null where only that can tell."""
    iq, il = initials_form(nq), initials_form(nl)
    same_tokens = (F.size(F.array_except(name_tokens(nq), name_tokens(nl))) == 0) & (F.size(F.array_except(name_tokens(nl), name_tokens(nq))) == 0)
    return (
        F.when((F.coalesce(query, F.lit("")) == "") | (F.coalesce(label, F.lit("")) == ""), _tier(0.0, "none"))
        .when(F.trim(query) == F.trim(label), _tier(1.0, "exact"))
        .when((nq != "") & (nq == nl), _tier(0.97, "normalized"))
        .when((nq != "") & (iq == il), _tier(0.90, "initials"))
        .when((nq != "") & same_tokens, _tier(0.88, "token"))
    )


def fuzzy_tier(query: Column, label: Column, nq: Column, nl: Column, ratio: Column, transliterated: Column | None = None) -> Column:
    """struct(score, how) of pairs that label_tier leaves open, given the similarity of their normal forms.

    ``transliterated`` is the similarity of their transliterations, where there is one: it counts for names in different
    scripts, and never for more than TRANSLITERATED_MOST. Without it names are their own transliterations.
    """
    blended = F.round(F.lit(0.6) * ratio + F.lit(0.4) * token_overlap(name_tokens(nq), name_tokens(nl)), 3)
    out = _tier(blended, "fuzzy")
    if transliterated is not None:
        better = (script_of(query) != script_of(label)) & (transliterated > ratio)
        out = F.when(better, _tier(F.round(F.least(transliterated, F.lit(TRANSLITERATED_MOST)), 3), "translit")).otherwise(out)
    return out


def with_match(pairs: DataFrame, query: str, label: str, nq: str, nl: str, out: str = "match") -> DataFrame:
    """pairs with ``out``: struct(score, how) of how well two names agree. Only pairs that need it pass the similarity UDF."""
    told = pairs.withColumn(out, label_tier(F.col(query), F.col(label), F.col(nq), F.col(nl)))
    fuzzy = told.filter(F.col(out).isNull()).withColumn("__ratio", sequence_ratio(nq, nl))
    fuzzy = fuzzy.withColumn(out, fuzzy_tier(F.col(query), F.col(label), F.col(nq), F.col(nl), F.col("__ratio"))).drop("__ratio")
    return told.filter(F.col(out).isNotNull()).unionByName(fuzzy)
