"""Reading filled-in sheets: headings, roles, countries and years in canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_k

# Other headings for each field, headings that may mean several fields, and words for roles.
ALIASES = {
    "name": ["talent name", "talent", "full name", "fullname", "title", "person", "person name", "celebrity", "influencer", "creator", "artist", "artist name", "profile name", "entity", "entity name"],
    "role": ["expected role", "category", "title category", "occupation", "profession", "type", "vertical", "sub category", "title sub category"],
    "active_year": ["year", "active year", "release year", "campaign year", "reference year"],
    "country": ["citizenship", "nationality", "market", "region", "country qid"],
    "context": ["show", "brand", "campaign", "programme", "program", "series", "project", "note context", "source"],
    "client": ["account", "customer", "brand set", "brandset"],
    "row_id": ["id", "row", "sr no", "srno", "s no", "sno", "index", "ticket", "ticket id", "request id", "row id"],
    "notes": ["note", "comment", "comments", "remarks"],
}
AMBIGUOUS = {"title": ["name", "role"], "type": ["role"], "category": ["role"]}
BUCKETS = ["actor", "director", "musician", "athlete", "creator", "model", "journalist", "politician", "writer", "executive", "comedian", "chef"]
ROLE_WORDS = {
    "musician": ["singer", "music", "musician/singer", "composer", "rapper", "band"],
    "actor": ["actress", "film", "tv", "movie"],
    "director": ["filmmaker", "producer"],
    "athlete": ["sports", "sport", "cricketer", "footballer"],
    "creator": ["youtuber", "streamer", "influencer", "content creator", "digital creator"],
    "journalist": ["anchor"],
    "writer": ["author"],
    "executive": ["ceo", "founder"],
}

_FIELD_OF = {a: f for f, names in ALIASES.items() for a in [f.replace("_", " "), *names]}
_ROLE_OF = {b: b for b in BUCKETS} | {w: r for r, words in ROLE_WORDS.items() for w in words}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def norm_header(raw: Column) -> Column:
    return squeezed(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[_\-./\\]", " "))


def canon_header(raw: Column, strict: bool = False) -> Column:
    """The field a heading stands for: an alias, else (unless strict) the longest alias of over three letters within it."""
    h = norm_header(raw)
    exact = F.try_element_at(_lookup(_FIELD_OF), h)
    if strict:
        return exact
    # the longest first; of equal length in the order of the table
    order = sorted((a for a in _FIELD_OF if len(a) > 3), key=lambda a: -len(a))
    loose = F.coalesce(*[F.when(h.contains(a), F.lit(_FIELD_OF[a])) for a in order])
    return F.coalesce(exact, F.when(F.length(h) <= 60, loose))


def canon_role(value: Column) -> Column:
    """The bucket of a role, null for one that is unknown."""
    return F.try_element_at(_lookup(_ROLE_OF), squeezed(F.coalesce(value, F.lit(""))))


def coerce_year(value: Column) -> Column:
    """The year before the first point, if it is one from 1800 to 2100."""
    y = F.when(F.trim(F.split_part(value, F.lit("."), F.lit(1))).rlike("^[0-9]+$"), F.trim(F.split_part(value, F.lit("."), F.lit(1)))).try_cast("int")
    return F.when(y.between(1800, 2100), y)


def canon_country(value: Column, ids: Column | None = None) -> Column:
    """An id upper-cased, a name looked up in the map ``ids`` (lower-cased name to id), else the value itself."""
    v = F.trim(value)
    known = F.try_element_at(ids, F.lower(v)) if ids is not None else F.lit(None).cast("string")
    return F.when(F.lower(v).rlike(r"^q\d+$"), F.upper(v)).otherwise(F.coalesce(known, v))


def validation_summary(rows: DataFrame, by: str) -> DataFrame:
    """Rows in all, valid, with a role, with warnings, for each ``by``."""
    name = F.trim(F.coalesce("name", F.lit(""))) != ""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(name).alias("valid"), F.count_if(name & (F.trim(F.coalesce("role", F.lit(""))) != "")).alias("with_role"), F.count_if(F.coalesce(F.size("warnings"), F.lit(0)) > 0).alias("with_warnings"))


def validation_preview(rows: DataFrame, by: str, row: str, warnings: int = 50, names: int = 10) -> DataFrame:
    """For each ``by``: the first warnings, with their rows, and the names of the first valid rows. Both are bounded before they are gathered."""
    said = rows.select(by, row, F.posexplode("warnings").alias("__p", "__w"))
    first = top_k(said, [by], [F.col(row), F.col("__p")], warnings, "__k")
    told = first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", F.concat(F.lit("row "), F.col(row).cast("string"), F.lit(": "), "__w").alias("w")))), lambda x: x["w"]), "; ").alias("warnings"))
    valid = top_k(rows.filter(F.trim(F.coalesce("name", F.lit(""))) != "").select(by, row, "name"), [by], [F.col(row)], names, "__k")
    seen = valid.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "name"))), lambda x: x["name"]), "; ").alias("preview"))
    return told.join(seen, by, "full")


def map_headers(header: Column) -> Column:
    """The field each heading of a sheet stands for, null where it is none or its field is taken.

    Headings that can mean one field claim it first, the first of several; those that may mean several then take the first
    of these that is left, in their order.
    """
    normal = F.transform(header, lambda h: norm_header(h))
    loose = F.transform(header, lambda h: canon_header(h))
    own = F.transform(normal, lambda h: h.isin(*AMBIGUOUS))
    sure = F.transform(loose, lambda f, i: F.when(~F.get(own, i), f))
    first = F.transform(sure, lambda f, i: F.when(F.array_position(sure, f) == i + 1, f))
    meant = F.create_map(*[x for k, v in AMBIGUOUS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(F.when(F.get(own, x), meant[F.get(normal, x)]), lambda f: ~F.array_contains(acc["claimed"], f))
        took = F.coalesce(F.get(first, x), F.get(free, F.lit(0)))
        return F.struct(F.array_append(acc["fields"], took).alias("fields"), F.when(took.isNull(), acc["claimed"]).otherwise(F.array_append(acc["claimed"], took)).alias("claimed"))

    start = F.struct(F.array().cast("array<string>").alias("fields"), F.array_compact(first).alias("claimed"))
    places = F.when(F.size(header) > 0, F.sequence(F.lit(0), F.size(header) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda acc: acc["fields"])


def header_score(cells: Column) -> Column:
    """Number of fields that the cells of a row name outright."""
    return F.size(F.array_compact(F.array_distinct(F.transform(cells, lambda c: canon_header(c, strict=True)))))


def header_rows(rows: DataFrame, sheet: str, row: str, cells: str, within: int = 15) -> DataFrame:
    """(sheet, row) of each sheet's heading: of its first rows with a name column the one that names most fields, the first of equals.

    Where no row names a name outright, the first whose headings hold one counts.
    """
    head = rows.filter(F.col(row) <= within)
    strict = F.exists(cells, lambda c: canon_header(c, strict=True).eqNullSafe(F.lit("name")))
    loose = F.exists(cells, lambda c: canon_header(c).eqNullSafe(F.lit("name")))
    told = head.select(sheet, row, F.when(strict, 2).when(loose, 1).alias("kind"), F.when(strict, header_score(F.col(cells))).otherwise(0).alias("score")).filter("kind IS NOT NULL")
    return told.groupBy(sheet).agg(F.max_by(row, F.struct("kind", "score", -F.col(row))).alias(row))


def quoted(s: Column) -> Column:
    """A text in quotes: single ones, or double ones where it holds single ones only."""
    inner = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    plain = ~s.contains("'") | s.contains('"')
    return F.when(plain, F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(F.concat(F.lit('"'), inner, F.lit('"')))


def row_warnings(role: Column, year: Column, name: Column) -> Column:
    """What is to be said of a row: an unknown role, a year that is none, a missing name."""
    r, y = F.trim(F.coalesce(role, F.lit(""))), F.trim(F.coalesce(year, F.lit("")))
    return F.array_compact(
        F.array(
            F.when((squeezed(r) != "") & canon_role(r).isNull(), F.concat(F.lit("unrecognised role "), quoted(r), F.lit(" - treated as unknown"))),
            F.when((y != "") & coerce_year(y).isNull(), F.concat(F.lit("ignored active_year "), quoted(y))),
            F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.lit("empty name - skipped")),
        )
    )
