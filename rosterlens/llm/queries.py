"""The queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..sources.tables import table
from . import canonical, leakage, lexicon, linkage, lookalikes, mixture, mojibake, spans, variants


def reference_lists(spark: SparkSession, folder: str) -> tuple[dict[str, list], dict[str, list[str]]]:
    """Entries and names of the two lists, which are fixed and small."""
    roles = [(r.role_id, r.role, None) for r in table(spark, folder, "role_ref").collect()]
    countries = [(r.country_id, r.country, list(r.aliases or [])) for r in table(spark, folder, "country_ref").collect()]
    foreign, codes = lexicon.country_names(spark, [r[1] for r in countries if r[1]])
    lists = {"role": canonical.entries_of(roles, lexicon.aliases("role")), "country": canonical.entries_of(countries, lexicon.aliases("country"), foreign, codes)}
    return lists, {"role": [r[1] for r in roles], "country": [r[1] for r in countries]}


def p2_mapped(spark: SparkSession, folder: str) -> DataFrame:
    lists, _ = reference_lists(spark, folder)
    return canonical.map_to_list(table(spark, folder, "parsed_row"), ["parsed_id"], lists)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    lists, names = reference_lists(spark, folder)
    rows = canonical.map_to_list(table(spark, folder, "parsed_row"), ["parsed_id"], lists)
    entry = F.when(F.col("field") == "role", F.col("value").isin(names["role"])).otherwise(F.col("value").isin(names["country"]))
    return rows.filter(F.col("ref_id").isNotNull() & ~entry).select("parsed_id", "field", "ref_id").distinct()


def _model(spark: SparkSession, folder: str):
    """The one model of names and notes."""
    return mojibake.fit(table(spark, folder, "talent_finder_template").select("name").unionAll(table(spark, folder, "parsed_row").select("notes")))


def _garbled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Garbled names of sheets and notes of parsed rows."""
    sheets, rows, model = table(spark, folder, "talent_finder_template"), table(spark, folder, "parsed_row"), _model(spark, folder)
    return mojibake.restore(sheets, "name", ["sheet_id"], model), mojibake.restore(rows, "notes", ["parsed_id"], model)


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _garbled(spark, folder)
    cols = ["text", "restored", "chains"]
    a = a.select(F.lit("talent_finder_template").alias("table_name"), F.col("sheet_id").alias("record_id"), *cols)
    return a.unionByName(b.select(F.lit("parsed_row").alias("table_name"), F.col("parsed_id").alias("record_id"), *cols)).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_restored(spark, folder).select("table_name", "record_id").distinct()


def p5_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Names and labels in one form, with what they held; garbled names are left to p4."""
    sheets = table(spark, folder, "talent_finder_template")
    a = lookalikes.unify(sheets, "name", ["sheet_id"]).withColumn("sheet_id", F.col("sheet_id").cast("string"))
    b = lookalikes.unify(table(spark, folder, "candidate"), "label", ["entity_id"])
    both = a.select(F.lit("talent_finder_template").alias("table_name"), F.col("sheet_id").alias("record_key"), "text", "unified", "kinds")
    return both.unionByName(b.select(F.lit("candidate").alias("table_name"), F.col("entity_id").alias("record_key"), "text", "unified", "kinds"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of the names that hold unusual characters those that are not garbled; only these are tried."""
    hits = materialise(p5_unified(spark, folder).filter(F.size("kinds") > 0).select("table_name", "record_key", "text").distinct(), "hits")
    garbled = mojibake.restore(hits.filter("table_name = 'talent_finder_template'"), "text", ["table_name", "record_key"], _model(spark, folder))
    return hits.select("table_name", "record_key").join(garbled.select("table_name", "record_key"), ["table_name", "record_key"], "left_anti").distinct()


def _roles_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "role_ref")


def _candidates(spark: SparkSession, folder: str, common: dict[str, int]) -> DataFrame:
    """Candidate records taken apart; buckets that only the occupations tell are added to the roles."""
    cand = table(spark, folder, "candidate").dropDuplicates(["entity_id"])
    buckets = {r.occupation: r.bucket for r in _roles_of(spark, folder).collect()}  # 39 rows
    of = F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv])
    told = F.array_distinct(F.concat(F.coalesce("roles", F.array().cast("array<string>")), F.array_compact(F.transform(F.coalesce("occupations", F.array().cast("array<string>")), lambda o: F.try_element_at(of, o)))))
    names = linkage.parse_names(cand, "entity_id", "label", common).withColumnRenamed("name", "label")
    return names.join(cand.select("entity_id", "occupations", told.alias("roles"), "birth_year", "death_year", "citizenship"), "entity_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_linked(spark, folder).select("intake_id", "entity_id")


def p1_linked(spark: SparkSession, folder: str) -> DataFrame:
    intake, cand = table(spark, folder, "intake").dropDuplicates(["intake_id"]), table(spark, folder, "candidate")
    common = linkage.common_words(cand.select("label"), intake.select("name"))
    asked = linkage.parse_names(intake, "intake_id", "name", common)
    facts = intake.select("intake_id", F.lit(None).cast("string").alias("occupation"), F.col("expected_role").alias("bucket"), "country", F.col("active_year").alias("year"))
    return linkage.link(asked.join(facts, "intake_id"), _candidates(spark, folder, common), "intake_id", "entity_id")


def p3_linked(spark: SparkSession, folder: str) -> DataFrame:
    """Sheet rows and the candidate records of the person they name, with both spellings."""
    sheets, cand = table(spark, folder, "talent_finder_template").dropDuplicates(["sheet_id"]), table(spark, folder, "candidate")
    sheets = materialise(sheets.select("sheet_id", "name", "role", "country", "active_year"), "sheets")  # read by every step
    common = linkage.common_words(cand.select("label"), sheets.select("name"))
    model = mojibake.fit(sheets.select("name"))
    asked = linkage.parse_names(sheets, "sheet_id", "name", common, model)
    lists, _ = reference_lists(spark, folder)
    told = canonical.map_to_list(sheets, ["sheet_id"], lists).filter(F.col("ref_id") != canonical.NONE).select("sheet_id", "field", "ref_id")
    role = told.filter("field = 'role'").join(F.broadcast(_roles_of(spark, folder).select(F.col("role_id").alias("ref_id"), "occupation", "bucket")), "ref_id").select("sheet_id", "occupation", "bucket")
    country = told.filter("field = 'country'").select("sheet_id", F.col("ref_id").alias("country"))
    year = F.when(F.trim("active_year").rlike(r"^[0-9]{4}(\.0)?$"), F.substring(F.trim("active_year"), 1, 4).cast("int")).alias("year")
    facts = sheets.select("sheet_id", year).join(role, "sheet_id", "left").join(country, "sheet_id", "left")
    linked = variants.link_variants(asked.join(facts, "sheet_id"), _candidates(spark, folder, common), "sheet_id", "entity_id")
    labels = cand.dropDuplicates(["entity_id"]).select("entity_id", "label")
    return linked.join(sheets.select("sheet_id", "name"), "sheet_id").join(labels, "entity_id").select("sheet_id", "entity_id", "name", "label", "confidence")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_linked(spark, folder).filter(F.col("name") != F.col("label")).select("sheet_id", "entity_id")


def p8_near(spark: SparkSession, folder: str) -> DataFrame:
    """Items that documents hold with up to one word replaced, inserted or dropped within the passage."""
    return leakage.leaked(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_item"), "item_id", "text", 12, 1).distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of the near passages those that hold twelve words unbroken."""
    return p8_near(spark, folder).filter("run >= 12").select("item_id", "doc_id").distinct()


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(table(spark, folder, "documents"), "doc_id", "text", 30)


def p10_portion(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return spans.shared_portion(docs, "doc_id", "text", p10_found(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Topic of a document: the first role of the person it is about."""
    topics = table(spark, folder, "candidate").groupBy("entity_id").agg(F.min(F.try_element_at("roles", F.lit(1))).alias("topic"))
    sized = mixture.count_tokens(table(spark, folder, "documents"), "text", ["doc_id", "lang", "source", "entity_id"])
    return mixture.mix(sized.join(topics, "entity_id", "left"), "doc_id", table(spark, folder, "mix_target"))


def p9_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def queries() -> dict:
    return {f.__name__: f for f in (p9_sample, p9_shares, p10_found, p10_portion, p8_found, p8_near, p3_found, p3_linked, p1_found, p1_linked, p5_found, p5_unified, p2_found, p2_mapped, p4_found, p4_restored)}


_LEAKS = r"""
WITH i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (gram)"""

_SPANS = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 29], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 28)) AS k FROM d)),
s AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
p AS (SELECT doc_id, k - 1 AS place FROM g JOIN s USING (gram)),
o AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) <= 30 THEN 0 ELSE 1 END AS fresh FROM p),
x AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY place) AS stretch FROM o)
SELECT doc_id, CAST(min(place) AS INTEGER) AS first_word, CAST(max(place) + 29 AS INTEGER) AS last_word FROM x GROUP BY doc_id, stretch"""

_PORTION = f"""
WITH every AS (SELECT doc_id, max(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda x: x <> ''))) AS words FROM documents GROUP BY 1),
held AS (SELECT doc_id, sum(last_word - first_word + 1) AS n FROM ({_SPANS}) GROUP BY 1)
SELECT doc_id, words, CAST(coalesce(n, 0) AS BIGINT) AS shared_words, CASE WHEN words > 0 THEN CAST(coalesce(n, 0) AS DOUBLE) / words END AS share FROM every LEFT JOIN held USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"p8_found": _LEAKS, "p10_found": _SPANS, "p10_portion": _PORTION}
