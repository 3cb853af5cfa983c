"""Queries for the engine's own operators, each over its whole tables, and their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, names, urls
from ..operators import evidence, export, ingest, ranking, store
from ..operators.nested import complete_json
from ..sources.cache import cached
from ..sources.tables import table
from . import resolve

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- evidence ----------------------------------------------------------------------------------------------------------

_EVIDENCE_SQL = """
WITH h AS (SELECT DISTINCT handle_id, evidence FROM handle WHERE json_valid(evidence) AND json_type(evidence) = 'ARRAY'),
e AS (SELECT handle_id, CAST(x->>'$.tier' AS INT) AS tier, coalesce(CAST(x->>'$.authoritative' AS BOOLEAN), FALSE) AS auth
      FROM (SELECT handle_id, unnest(CAST(evidence AS JSON[])) AS x FROM h)),
g AS (SELECT handle_id, count(tier) AS n_evidence, min(tier) AS best_tier, bool_or(auth) AS auth,
        count(*) FILTER (tier = 1) AS t1, count(*) FILTER (tier = 2) AS t2, count(*) FILTER (tier = 3) AS t3, count(*) FILTER (tier = 4) AS t4, count(*) FILTER (tier = 5) AS t5
      FROM e GROUP BY 1),
c AS (SELECT *, 1.0::DOUBLE - (((((1.0::DOUBLE * CASE WHEN t1 > 0 THEN 1.0::DOUBLE - 0.55::DOUBLE ELSE 1.0::DOUBLE END) * CASE WHEN t2 > 0 THEN 1.0::DOUBLE - 0.45::DOUBLE ELSE 1.0::DOUBLE END)
        * CASE WHEN t3 > 0 THEN 1.0::DOUBLE - 0.78::DOUBLE ELSE 1.0::DOUBLE END) * CASE WHEN t4 > 0 THEN 1.0::DOUBLE - 0.38::DOUBLE ELSE 1.0::DOUBLE END))
        + ((((CASE WHEN t1 > 1 THEN 0.03::DOUBLE * least(t1 - 1, 2) ELSE 0.0::DOUBLE END) + CASE WHEN t2 > 1 THEN 0.03::DOUBLE * least(t2 - 1, 2) ELSE 0.0::DOUBLE END)
        + CASE WHEN t3 > 1 THEN 0.03::DOUBLE * least(t3 - 1, 2) ELSE 0.0::DOUBLE END) + CASE WHEN t4 > 1 THEN 0.03::DOUBLE * least(t4 - 1, 2) ELSE 0.0::DOUBLE END) AS raw FROM g),
f AS (SELECT *, round(least(CASE WHEN auth AND raw < 0.8 THEN 0.8::DOUBLE ELSE raw END, 0.99::DOUBLE), 3) AS confidence FROM c)
SELECT handle_id, n_evidence, best_tier, confidence,
  CASE WHEN t5 > 0 AND t1 + t2 + t3 + t4 = 0 THEN 'reject' WHEN confidence >= 0.75 THEN 'accept' WHEN confidence >= 0.35 THEN 'review' ELSE 'reject' END AS verdict
FROM f"""


def _evidence_rows(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "handle").select("handle_id", "evidence").distinct()
    rows = F.try_variant_get(complete_json(F.col("evidence")), "$", "array<variant>")
    e = h.select("handle_id", F.explode(rows).alias("x"))
    return e.select("handle_id", F.try_variant_get("x", "$.tier", "int").alias("tier"), F.coalesce(F.try_variant_get("x", "$.authoritative", "boolean"), F.lit(False)).alias("authoritative"))


@query(_EVIDENCE_SQL)
def handle_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.claim_confidence(_evidence_rows(spark, folder), ["handle_id"])


@query("SELECT entity_id, round(count(DISTINCT CASE WHEN verdict = 'accept' THEN platform END) / 8.0::DOUBLE, 3) AS coverage FROM handle GROUP BY 1")
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.coverage(table(spark, folder, "handle"), "entity_id")


@query("SELECT platform, verdict, count(DISTINCT handle_id) AS n FROM handle GROUP BY 1, 2")
def decision_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "handle").groupBy("platform", "verdict").agg(F.count_distinct("handle_id").alias("n"))


@query("""
SELECT entity_id, 'account' AS kind, platform AS key, handle AS value FROM (SELECT DISTINCT entity_id, platform, handle FROM handle WHERE verdict = 'accept')
UNION ALL
SELECT entity_id, 'external' AS kind, k AS key, external_ids[k] AS value FROM (SELECT DISTINCT entity_id, external_ids, unnest(map_keys(external_ids)) AS k FROM candidate WHERE external_ids IS NOT NULL)""")
def evidence_union(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "handle").filter("verdict = 'accept'").select("entity_id", F.lit("account").alias("kind"), F.col("platform").alias("key"), F.col("handle").alias("value")).distinct()
    b = table(spark, folder, "candidate").dropDuplicates(["entity_id"]).select("entity_id", F.lit("external").alias("kind"), F.explode("external_ids"))
    return a.unionByName(b)


@query("""
WITH s AS (SELECT DISTINCT entity_id, platform, 0 AS stage FROM handle WHERE verdict = 'accept' UNION ALL SELECT DISTINCT entity_id, platform, 1 FROM handle WHERE verdict = 'review'
  UNION ALL SELECT DISTINCT entity_id, platform, 2 FROM handle WHERE verdict = 'reject')
SELECT entity_id, platform, stage FROM s WHERE stage = (SELECT min(stage) FROM s x WHERE x.entity_id = s.entity_id)""")
def fallback_chain(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "handle")
    stages = [h.filter(F.col("verdict") == v).select("entity_id", "platform").distinct() for v in ("accept", "review", "reject")]
    return store.fallback(stages, "entity_id").select("entity_id", "platform", "stage")


_LIST = "coalesce(string_agg(DISTINCT CASE WHEN {c} THEN {v} END, ' | ' ORDER BY CASE WHEN {c} THEN {v} END), '')"


@query(
    "SELECT entity_id, "
    + ", ".join(_LIST.format(c=f"verdict = 'accept' AND platform = '{p}'", v="handle") + f" AS {p}" for p in urls.PLATFORMS)
    + ", " + _LIST.format(c="verdict = 'review'", v="platform || ':' || handle") + " AS needs_review FROM handle GROUP BY 1"
)
def pivot_export(spark: SparkSession, folder: str) -> DataFrame:
    return export.pivot_accounts(table(spark, folder, "handle"), "entity_id")


# -- URLs --------------------------------------------------------------------------------------------------------------

#: Shapes a handle's URL is put into, by handle_id: URL and what it must be classified as (platform, handle, id_kind).
_SHAPES = [
    ("'https://m.facebook.com/' || handle", "'facebook'", "handle", "'handle'"),
    ("'https://www.facebook.com/profile.php?id=' || handle_id || '&sk=about'", "'facebook'", "CAST(handle_id AS {s})", "'numeric_id'"),
    ("'x.com/i/user/' || handle_id", "'twitter'", "CAST(handle_id AS {s})", "'numeric_id'"),
    ("'//twitter.com/@' || handle || '?utm_source=a'", "'twitter'", "handle", "'handle'"),
    ("'https://www.instagram.com/' || handle || '/?igshid=1'", "'instagram'", "handle", "'handle'"),
    ("'https://www.instagram.com/p/' || handle", "NULL", "NULL", "NULL"),
    ("'https://youtube.com/@' || handle", "'youtube'", "handle", "'handle'"),
    ("'https://youtube.com/c/' || handle", "'youtube'", "handle", "'handle'"),
    ("'https://youtube.com/watch?v=' || handle", "NULL", "NULL", "NULL"),
    ("'https://youtu.be/' || handle", "NULL", "NULL", "NULL"),
    ("'https://www.tiktok.com/@' || handle || '?lang=en'", "'tiktok'", "handle", "'handle'"),
    ("'https://www.linkedin.com/in/' || handle || '/'", "'linkedin'", "handle", "'handle'"),
    ("'https://www.linkedin.com/company/' || handle", "'linkedin'", "handle", "'company'"),
    ("'https://www.imdb.com/name/NM' || (1000000 + handle_id) || '/?ref_=x'", "'imdb'", "'nm' || (1000000 + handle_id)", "'nm_id'"),
    ("'https://netflix.com/' || handle", "NULL", "NULL", "NULL"),
    ("'https://hi.wikipedia.org/wiki/Category:' || handle", "NULL", "NULL", "NULL"),
    ("'https://hi.m.wikipedia.org/wiki/' || handle || '/x%20y'", "'wikipedia'", "replace(handle, '_', ' ') || '/x y'", "'page_title'"),
    ("'https://www.wikipedia.org/w?title=' || handle || '&oldid=1'", "'wikipedia'", "replace(handle, '_', ' ')", "'page_title'"),
    ("'https://www.facebook.com/pages/' || handle || '/' || handle_id", "'facebook'", "CAST(handle_id AS {s})", "'numeric_id'"),
    ("'https://www.linkedin.com/school/' || handle || '/about'", "'linkedin'", "handle", "'company'"),
    ("'http://youtube.com/user/' || handle || '#x'", "'youtube'", "handle", "'handle'"),
    ("'https://www.youtube.com/channel/UC' || lpad(CAST(handle_id AS {s}), 22, '0')", "'youtube'", "'UC' || lpad(CAST(handle_id AS {s}), 22, '0')", "'channel_id'"),
    ("'mobile.youtube.com/UC' || lpad(CAST(handle_id AS {s}), 22, 'x')", "'youtube'", "'UC' || lpad(CAST(handle_id AS {s}), 22, 'x')", "'channel_id'"),
]


def _case(column: int, string: str) -> str:
    return f"CASE handle_id % {len(_SHAPES)} " + " ".join(f"WHEN {i} THEN {s[column].format(s=string)}" for i, s in enumerate(_SHAPES)) + " END"


@query(f"SELECT handle_id, platform, acct AS handle, id_kind FROM (SELECT DISTINCT handle_id, {_case(1, 'VARCHAR')} AS platform, {_case(2, 'VARCHAR')} AS acct, {_case(3, 'VARCHAR')} AS id_kind FROM handle)")
def classify_urls(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "handle").select("handle_id", F.expr(_case(0, "STRING")).alias("url")).distinct()
    return h.select("handle_id", urls.classify_url(F.col("url")).alias("ref")).select("handle_id", "ref.platform", "ref.handle", "ref.id_kind")


@query("""SELECT DISTINCT handle_id, CASE
  WHEN platform = 'facebook' AND id_kind = 'numeric_id' THEN 'https://www.facebook.com/profile.php?id=' || h WHEN platform = 'facebook' THEN 'https://www.facebook.com/' || h
  WHEN platform = 'instagram' THEN 'https://www.instagram.com/' || h || '/' WHEN platform = 'twitter' AND id_kind = 'numeric_id' THEN 'https://x.com/i/user/' || h
  WHEN platform = 'twitter' THEN 'https://x.com/' || h WHEN platform = 'youtube' AND regexp_full_match(h, 'UC[0-9A-Za-z_-]{22}') THEN 'https://www.youtube.com/channel/' || h
  WHEN platform = 'youtube' THEN 'https://www.youtube.com/@' || h WHEN platform = 'tiktok' THEN 'https://www.tiktok.com/@' || h
  WHEN platform = 'linkedin' AND id_kind = 'company' THEN 'https://www.linkedin.com/company/' || h || '/' WHEN platform = 'linkedin' THEN 'https://www.linkedin.com/in/' || h || '/'
  WHEN platform = 'imdb' THEN 'https://www.imdb.com/name/' || lower(h) || '/' WHEN platform = 'wikipedia' THEN 'https://' || coalesce(lang, 'en') || '.wikipedia.org/wiki/' || replace(handle, ' ', '_') END AS url,
  platform || ':' || lower(handle) || CASE WHEN coalesce(lang, '') <> '' THEN '@' || lang ELSE '' END AS ref_key
FROM (SELECT *, regexp_replace(handle, '^@', '') AS h FROM handle)""")
def build_urls(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "handle")
    c = {n: F.col(n) for n in ("platform", "handle", "lang", "id_kind")}
    return h.select("handle_id", urls.build_url(c["platform"], c["handle"], c["lang"], c["id_kind"]).alias("url"), urls.ref_key(c["platform"], c["handle"], c["lang"]).alias("ref_key")).distinct()


@query("""WITH u AS (SELECT DISTINCT doc_id, trim(url) AS u FROM documents WHERE url IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN u LIKE '//%' THEN 'https:' || u WHEN contains(u, '://') THEN u ELSE 'https://' || u END AS a FROM u),
p AS (SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_extract(a, '^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^[.]+', ''), '^(?:m|mobile)[.]', '') AS host,
  regexp_replace(regexp_extract(a, '^[^:/?#]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(a, '^[^?#]*[?]([^#]*)', 1) AS q FROM s),
k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '=.') AND NOT regexp_matches(lower(x), '^(?:utm_|fb|ig|_r|_t|si|gclid|mc_)')), '&') AS kept FROM p)
SELECT doc_id, 'https://' || host || path || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS url FROM k""")
def canonical_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("url IS NOT NULL").select("doc_id", urls.canonical_form(F.col("url")).alias("url")).distinct()


@query("""SELECT DISTINCT url_hash, regexp_replace(regexp_replace(u, '(?i)([?&])(api_key|apikey|key|token|access_token)=[^&]*', '\\1\\2=REDACTED', 'g'), '(?i)([?&])(api_key|apikey|key|token|access_token)(&|$)', '\\1\\2=\\3', 'g') AS url,
  sha256(url) AS cache_key FROM (SELECT url_hash, url, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'api_key=' || substr(url_hash, 1, 6) || '&monkey=1&token' AS u FROM http_cache)""")
def redact_urls(spark: SparkSession, folder: str) -> DataFrame:
    u = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("api_key="), F.substring("url_hash", 1, 6), F.lit("&monkey=1&token"))
    return table(spark, folder, "http_cache").select("url_hash", urls.redact(u).alias("url"), urls.cache_key(F.col("url")).alias("cache_key")).distinct()


_SERVICES = urls.AGGREGATORS
_HOST = "CASE handle_id % 4 WHEN 0 THEN 'https://www.' || d || '/' || handle WHEN 1 THEN 'https://' || handle_id || '.' || d WHEN 2 THEN 'https://not' || d || '/x' ELSE 'https://' || d || '.example/' END"


@query("SELECT DISTINCT handle_id, handle_id % 4 < 2 AS aggregator FROM handle")
def aggregator_hosts(spark: SparkSession, folder: str) -> DataFrame:
    d = F.element_at(F.array(*map(F.lit, _SERVICES)), (F.col("handle_id") % len(_SERVICES) + 1).cast("int"))
    return table(spark, folder, "handle").withColumn("d", d).select("handle_id", urls.is_aggregator(F.expr(_HOST)).alias("aggregator")).distinct()


@query("""WITH c AS (SELECT DISTINCT url_hash, body FROM http_cache WHERE kind = 'text' AND body IS NOT NULL),
l AS (SELECT url_hash, list_distinct(regexp_extract_all(body, '(?i)href=["''](https?://[^"''<>\\s]+)["'']', 1)) AS l FROM c)
SELECT url_hash, unnest(l) AS link FROM l""")
def extract_links(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "http_cache").filter("kind = 'text' AND body IS NOT NULL").select("url_hash", "body").distinct()
    return pages.select("url_hash", F.explode(extract.extract_links(F.col("body"))).alias("link"))


@query("""SELECT DISTINCT url_hash, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(body, '(?is)<script.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS words FROM http_cache WHERE kind = 'text' AND body IS NOT NULL""")
def page_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "http_cache").filter("kind = 'text' AND body IS NOT NULL").select("url_hash", extract.visible_words(F.col("body")).cast("bigint").alias("words")).distinct()


@query("""WITH c AS (SELECT DISTINCT url_hash, body FROM http_cache WHERE kind = 'json' AND json_valid(body))
SELECT url_hash, count(*) AS n_strings, string_agg(t.atom->>'$', chr(10) ORDER BY t.id) AS strings FROM c, json_tree(body) t WHERE t.type = 'VARCHAR' GROUP BY 1""")
def json_string_leaves(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "http_cache").filter("kind = 'json' AND body IS NOT NULL").select("url_hash", "body").distinct()
    told = pages.select("url_hash", extract.json_strings(F.col("body")).alias("s")).filter("size(s) > 0")
    return told.select("url_hash", F.size("s").cast("bigint").alias("n_strings"), F.array_join("s", "\n").alias("strings"))


@query("""WITH c AS (SELECT DISTINCT url_hash, CAST(body AS JSON) AS j FROM http_cache WHERE kind = 'json' AND json_valid(body) AND json_exists(body, '$.entities')),
i AS (SELECT url_hash, k AS item, json_extract(j, '$.entities."' || k || '"') AS x FROM (SELECT url_hash, j, unnest(json_keys(j, '$.entities')) AS k FROM c)),
l AS (SELECT url_hash, item, x->('$.labels."' || lang || '".value') AS v FROM (SELECT url_hash, item, x, unnest(json_keys(x, '$.labels')) AS lang FROM i))
SELECT url_hash, item, count(DISTINCT v) AS n_labels FROM l WHERE v IS NOT NULL GROUP BY 1, 2""")
def item_labels(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "http_cache").filter("kind = 'json'").select("url_hash", complete_json(F.col("body")).alias("v")).filter("v IS NOT NULL")
    items = pages.select("url_hash", F.explode(F.try_variant_get("v", "$.entities", "map<string,variant>")).alias("item", "x"))
    labels = items.select("url_hash", "item", F.explode(F.try_variant_get("x", "$.labels", "map<string,variant>")).alias("lang", "l"))
    return labels.select("url_hash", "item", F.try_variant_get("l", "$.value", "string").alias("v")).filter("v IS NOT NULL").groupBy("url_hash", "item").agg(F.count_distinct("v").alias("n_labels"))


@query("SELECT kind, count(*) AS calls, count(*) FILTER (status = 200) AS hits, count(*) FILTER (status <> 200) AS errors, coalesce(sum(length(body)), 0)::BIGINT AS chars FROM http_cache GROUP BY 1")
def fetch_stats(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "http_cache")
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == 200).alias("hits"), F.count_if(F.col("status") != 200).alias("errors"), F.coalesce(F.sum(F.length("body")), F.lit(0)).cast("bigint").alias("chars"))


# -- names -------------------------------------------------------------------------------------------------------------

_NORMAL = r"""regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({x}), '&', ' and '), '([a-z])[.]', '\1 ', 'g'), '[^\p{{L}}\p{{N}}_\t\n\f\r ]+', ' ', 'g'), '[\t\n\f\r ]+', ' ', 'g')),
  '^(?:(?:""" + "|".join(names.HONORIFICS) + r""")(?: |$))+', ''), '(?:(?:^| )(?:""" + "|".join(names.SUFFIXES) + r"""))+$', '')"""
_INITIALS = "CASE WHEN len(string_split({n}, ' ')) > 1 THEN array_to_string(list_concat([x[1:1] for x in string_split({n}, ' ')[:-2]], string_split({n}, ' ')[-1:]), ' ') ELSE {n} END"


@query(f"""WITH c AS (SELECT DISTINCT entity_id, label, {_NORMAL.format(x='label')} AS normal FROM candidate WHERE label IS NOT NULL)
SELECT entity_id, normal, {_INITIALS.format(n='normal')} AS initials, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS slug FROM c""")
def normal_names(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "candidate").filter("label IS NOT NULL").select("entity_id", "label").distinct()
    n = resolve.with_normal(c, "label", marks=False)
    return n.select("entity_id", "normal", names.initials_form(F.col("normal")).alias("initials"), names.slug(F.col("label")).alias("slug"))


@query()
def stripped_names(spark: SparkSession, folder: str) -> DataFrame:
    """Normal forms with marks stripped (NFKD has no SQL equivalent; unit tests hold the values), script and languages."""
    c = table(spark, folder, "candidate").filter("label IS NOT NULL").select("entity_id", "label").distinct()
    n = resolve.with_normal(c, "label")
    return n.select("entity_id", "normal", names.script_of(F.col("label")).alias("script"), F.array_join(names.search_languages(F.col("label")), ",").alias("languages"))


@query()
def fuzzy_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of typed names and labels that share their initials form."""
    i, c = table(spark, folder, "intake").dropDuplicates(["intake_id"]), table(spark, folder, "candidate").dropDuplicates(["entity_id"])
    pairs = resolve.recall(i, "intake_id", "name", c, "entity_id", "label").join(i.select("intake_id", "name"), "intake_id").join(c.select("entity_id", "label"), "entity_id")
    return pairs.select("intake_id", "entity_id", F.round(names.sequence_ratio(F.lower("name"), F.lower("label")), 6).alias("ratio"))


@query(r"""WITH t AS (SELECT DISTINCT entity_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(label), '[^a-z0-9 ]+', '', 'g')), ' +'), lambda x: x <> '') AS w FROM candidate WHERE label IS NOT NULL),
o AS (SELECT entity_id, CASE WHEN len(w) > 1 THEN [array_to_string(w, ''), array_to_string(w, '_'), array_to_string(w, '') || 'music', w[1] || w[-1]] ELSE [array_to_string(w, '')] END AS o FROM t),
d AS (SELECT entity_id, list_filter(o, lambda h: length(h) BETWEEN 3 AND 40) AS o FROM o)
SELECT entity_id, array_to_string(list_filter(o, lambda h, i: list_position(o, h) = i), ',') AS handles FROM d""")
def handle_guesses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate").filter("label IS NOT NULL").select("entity_id", F.array_join(urls.handle_candidates(F.col("label")), ",").alias("handles")).distinct()


_PAIRS_SQL = f"""
WITH i AS (SELECT DISTINCT ON (intake_id) intake_id, name, expected_role AS role, country, active_year AS yr, {_NORMAL.format(x='name')} AS n FROM intake WHERE name IS NOT NULL),
c AS (SELECT DISTINCT ON (entity_id) entity_id, label, roles, citizenship, birth_year, death_year, external_ids, {_NORMAL.format(x='label')} AS n FROM candidate WHERE label IS NOT NULL),
ik AS (SELECT intake_id, n AS k FROM i WHERE n <> '' UNION SELECT intake_id, {_INITIALS.format(n='n')} FROM i WHERE n <> ''),
ck AS (SELECT entity_id, n AS k FROM c WHERE n <> '' UNION SELECT entity_id, {_INITIALS.format(n='n')} FROM c WHERE n <> ''),
p AS (SELECT DISTINCT intake_id, entity_id FROM ik JOIN ck USING (k)),
t AS (SELECT p.intake_id, p.entity_id, role, country, yr, roles, citizenship, birth_year, death_year, external_ids,
  CASE WHEN trim(name) = trim(label) THEN 1.0::DOUBLE WHEN i.n = c.n THEN 0.97::DOUBLE WHEN {_INITIALS.format(n='i.n')} = {_INITIALS.format(n='c.n')} THEN 0.9::DOUBLE
    WHEN list_sort(list_distinct(string_split(i.n, ' '))) = list_sort(list_distinct(string_split(c.n, ' '))) THEN 0.88::DOUBLE END AS label_score
  FROM p JOIN i USING (intake_id) JOIN c USING (entity_id)),
s AS (SELECT *, round(
    CASE WHEN role IS NULL THEN 0.0::DOUBLE WHEN coalesce(list_contains(roles, role), FALSE) THEN 0.6::DOUBLE WHEN coalesce(len(roles), 0) > 0 THEN -0.25::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN country IS NULL OR coalesce(len(citizenship), 0) = 0 THEN 0.0::DOUBLE WHEN list_contains(citizenship, country) THEN 0.15::DOUBLE ELSE -0.1::DOUBLE END
  + CASE WHEN yr IS NULL OR birth_year IS NULL THEN 0.0::DOUBLE WHEN yr - birth_year BETWEEN 12 AND 90 THEN 0.15::DOUBLE ELSE -0.3::DOUBLE END
  + CASE WHEN coalesce(death_year < yr, FALSE) THEN -0.4::DOUBLE ELSE 0.0::DOUBLE END + 0.02::DOUBLE * least(coalesce(len(map_keys(external_ids)), 0), 6), 3) AS base FROM t WHERE label_score >= 0.62),
r AS (SELECT intake_id, entity_id, label_score, round(base + (label_score - 1) * 0.5::DOUBLE, 3) AS role_score FROM s)
"""


def _scored(spark: SparkSession, folder: str, full: bool = True) -> DataFrame:
    """Scored pairs; if not full, those SQL can tell: marks are left in names, which meet by normal and initials forms only."""
    i = table(spark, folder, "intake").select("intake_id", "name", F.col("expected_role").alias("role"), "country", F.col("active_year").alias("year")).filter("name IS NOT NULL")
    c = table(spark, folder, "candidate").select("entity_id", "label", "roles", "citizenship", "birth_year", "death_year", "external_ids").filter("label IS NOT NULL")
    c = c.dropDuplicates(["entity_id"])
    pairs = resolve.recall(i, "intake_id", "name", c, "entity_id", "label", marks=full, every=full)
    return resolve.scored(pairs, i, c, "intake_id", "entity_id", "name", "label", marks=full)


@query()
def role_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The whole of it, as are the next three: every spelling, marks stripped, all tiers of agreement; a test by brute force holds the values."""
    return _scored(spark, folder).select("intake_id", "entity_id", "label_score", "how", "role_score")


@query()
def rank_margin(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank(_scored(spark, folder), "intake_id", "role_score", "entity_id")


@query()
def disambiguation_cards(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top_k(_scored(spark, folder), ["intake_id"], [F.desc("role_score"), F.col("entity_id")], 6, "card").select("intake_id", "entity_id", "card")


@query()
def unmatched_intakes(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "intake").filter("name IS NOT NULL").select("intake_id").distinct()
    return i.join(_scored(spark, folder), "intake_id", "left_anti")


@query(_PAIRS_SQL + "SELECT intake_id, entity_id, label_score, role_score FROM r")
def plain_role_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, False).select("intake_id", "entity_id", "label_score", "role_score")


@query(_PAIRS_SQL + """, w AS (SELECT *, row_number() OVER (PARTITION BY intake_id ORDER BY role_score DESC, entity_id) AS k, count(*) OVER (PARTITION BY intake_id) AS n, lead(role_score) OVER (PARTITION BY intake_id ORDER BY role_score DESC, entity_id) AS nxt FROM r)
SELECT intake_id, n, entity_id AS top, role_score AS top_score, round(role_score - nxt, 3) AS gap,
  CASE WHEN n = 1 THEN 'resolved' WHEN role_score <= 0 THEN 'disambiguate' WHEN round(role_score - nxt, 3) >= 0.25 THEN 'resolved' ELSE 'disambiguate' END AS decision FROM w WHERE k = 1""")
def plain_rank_margin(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank(_scored(spark, folder, False), "intake_id", "role_score", "entity_id")


@query(_PAIRS_SQL + "SELECT intake_id, entity_id, k AS card FROM (SELECT *, row_number() OVER (PARTITION BY intake_id ORDER BY role_score DESC, entity_id) AS k FROM r) WHERE k <= 6")
def plain_cards(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top_k(_scored(spark, folder, False), ["intake_id"], [F.desc("role_score"), F.col("entity_id")], 6, "card").select("intake_id", "entity_id", "card")


@query(_PAIRS_SQL + "SELECT intake_id FROM i WHERE intake_id NOT IN (SELECT intake_id FROM r)")
def plain_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "intake").filter("name IS NOT NULL").select("intake_id").distinct()
    return i.join(_scored(spark, folder, False), "intake_id", "left_anti")


@query("""WITH c AS (SELECT DISTINCT ON (entity_id) entity_id, label, roles FROM candidate WHERE label IS NOT NULL),
n AS (SELECT label, count(*) AS n_candidates FROM c GROUP BY 1 HAVING count(*) > 1)
SELECT label, n_candidates, coalesce((SELECT string_agg(DISTINCT r, ',' ORDER BY r) FROM (SELECT label AS l, unnest(roles) AS r FROM c) x WHERE x.l = n.label), '') AS roles FROM n""")
def collision_registry(spark: SparkSession, folder: str) -> DataFrame:
    return store.collisions(table(spark, folder, "candidate").filter("label IS NOT NULL").dropDuplicates(["entity_id"]), "label", "roles")


@query("""SELECT entity_id, string_agg(DISTINCT bucket, ',' ORDER BY bucket) AS roles FROM (SELECT DISTINCT entity_id, unnest(occupations) AS occupation FROM candidate) JOIN role_ref USING (occupation) GROUP BY 1""")
def role_lookup(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "candidate").select("entity_id", F.explode("occupations").alias("occupation"))
    dim = table(spark, folder, "role_ref").select("occupation", "bucket")  # 39 rows
    return o.join(F.broadcast(dim), "occupation").groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("bucket")), ",").alias("roles"))


@query("""SELECT entity_id, platform, handle FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE platform WHEN 'instagram' THEN 0 WHEN 'twitter' THEN 1 WHEN 'youtube' THEN 2 ELSE 3 END, handle_id) AS k
  FROM handle WHERE platform IN ('instagram', 'twitter', 'youtube', 'tiktok')) WHERE k = 1""")
def seed_choice(spark: SparkSession, folder: str) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, ("instagram", "twitter", "youtube", "tiktok"))), F.col("platform"))
    h = table(spark, folder, "handle").select("entity_id", "platform", "handle", "handle_id", order.alias("o")).filter("o > 0")
    return ranking.first_of(h, ["entity_id"], ["o", "handle_id"]).select("entity_id", "platform", "handle")


# -- sheets ------------------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT sheet_id, CASE WHEN regexp_full_match(y, '[0-9]+') AND TRY_CAST(y AS INT) BETWEEN 1800 AND 2100 THEN TRY_CAST(y AS INT) END AS year FROM (SELECT sheet_id, trim(split_part(active_year, '.', 1)) AS y FROM talent_finder_template)""")
def year_coerce(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "talent_finder_template").select("sheet_id", ingest.coerce_year(F.col("active_year")).alias("year")).distinct()


def _values(d: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in d.items())


@query(f"""WITH w(word, bucket) AS (VALUES {_values(ingest._ROLE_OF)})
SELECT parsed_id, bucket FROM (SELECT DISTINCT parsed_id, trim(regexp_replace(lower(coalesce(role, '')), '\\s+', ' ', 'g')) AS r FROM parsed_row) LEFT JOIN w ON r = word""")
def role_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "parsed_row").select("parsed_id", ingest.canon_role(F.col("role")).alias("bucket")).distinct()


@query("""SELECT DISTINCT parsed_id, CASE WHEN regexp_full_match(lower(trim(country)), 'q[0-9]+') THEN upper(trim(country)) ELSE coalesce((SELECT min(country_id) FROM country_ref r WHERE lower(r.country) = lower(trim(p.country))), trim(p.country)) END AS country FROM parsed_row p""")
def country_canon(spark: SparkSession, folder: str) -> DataFrame:
    known = {r.country.lower(): r.country_id for r in table(spark, folder, "country_ref").collect()}  # 67 rows
    ids = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return table(spark, folder, "parsed_row").select("parsed_id", ingest.canon_country(F.col("country"), ids).alias("country")).distinct()


@query(f"""WITH a(alias, field) AS (VALUES {_values(ingest._FIELD_OF)}),
h AS (SELECT DISTINCT x AS heading, trim(regexp_replace(regexp_replace(lower(x), '[_./\\\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM (SELECT unnest(header) AS x FROM parse_result))
SELECT heading, field FROM h LEFT JOIN a ON n = alias""")
def header_alias(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "parse_result").select(F.explode("header").alias("heading")).distinct()
    return h.select("heading", ingest.canon_header(F.col("heading"), strict=True).alias("field"))


@query("""SELECT file_id, count(*) AS n_rows, count(*) FILTER (trim(coalesce(name, '')) <> '') AS valid, count(*) FILTER (trim(coalesce(name, '')) <> '' AND trim(coalesce(role, '')) <> '') AS with_role, count(*) FILTER (coalesce(len(warnings), 0) > 0) AS with_warnings FROM parsed_row GROUP BY 1""")
def validation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.validation_summary(table(spark, folder, "parsed_row"), "file_id")


@query("""WITH d AS (SELECT DISTINCT ON (parsed_id) parsed_id, file_id, row_number AS rn, trim(coalesce(name, '')) <> '' AS ok FROM parsed_row)
SELECT parsed_id, CASE WHEN NOT ok THEN 'skipped' WHEN row_number() OVER (PARTITION BY file_id, ok ORDER BY rn, parsed_id) <= 10 THEN 'processed' ELSE 'unprocessed' END AS status FROM d""")
def batch_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "parsed_row").dropDuplicates(["parsed_id"])
    return store.batch_split(rows, "file_id", ["row_number", "parsed_id"], 10, F.trim(F.coalesce("name", F.lit(""))) != "").select("parsed_id", "status")


# -- state -------------------------------------------------------------------------------------------------------------


@query("""SELECT entity_id, platform, handle, lang, handle_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, platform, handle, lang ORDER BY updated_at DESC, handle_id DESC) AS k FROM handle) WHERE k = 1""")
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "handle").select("entity_id", "platform", "handle", "lang", "handle_id", "confidence", "updated_at")
    return store.latest(h, ["entity_id", "platform", "handle", "lang"], ["updated_at", "handle_id"]).drop("updated_at")


@query("""SELECT url_hash, kind, status FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY fetched_at DESC) AS k FROM http_cache) WHERE k = 1 AND epoch_us(TIMESTAMP '2025-07-01 00:00:00') - epoch_us(fetched_at) < 7776000000000""")
def cache_ttl(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "http_cache").select("url_hash", "kind", "status", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    return cached(c, F.lit("2025-07-01 00:00:00").cast("timestamp_ntz").cast("timestamp"), 90 * 86400).select("url_hash", "kind", "status")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("event_type", F.window("ts", "1 day").alias("w")).count().select("event_type", F.col("w.start").alias("day"), F.col("count").alias("n"))
