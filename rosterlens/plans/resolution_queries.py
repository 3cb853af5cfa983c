"""Queries for the steps of a resolution: names, items, claims, searches, sheets and jobs, with their equivalents in SQL.

Pages, answers and records that the tables do not hold are built from the tables, the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, names, urls
from ..operators import authorities, claims, discovery, evidence, export, ingest, jobs, ranking, store
from ..sources import cache, sheets
from ..sources.tables import table
from . import resolve
from .reference_queries import _INITIALS, _NORMAL, _PAIRS_SQL, _scored, _values

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


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate").filter("label IS NOT NULL").dropDuplicates(["entity_id"])


def _intakes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "intake").filter("name IS NOT NULL").dropDuplicates(["intake_id"])


# -- names -------------------------------------------------------------------------------------------------------------

_WORDS = f"SELECT DISTINCT entity_id, trim(label, ' ') AS raw, label, {_NORMAL.format(x='label')} AS n FROM candidate WHERE label IS NOT NULL"


@query(rf"""WITH c AS ({_WORDS}), w AS (SELECT *, list_filter(string_split(n, ' '), lambda x: x <> '') AS t FROM c),
v AS (SELECT entity_id, [raw, n, CASE WHEN len(t) > 1 THEN {_INITIALS.format(n='n')} ELSE '' END, CASE WHEN len(t) > 1 THEN t[1] || ' ' || t[-1] ELSE '' END,
  CASE WHEN len(t) > 1 AND length(array_to_string(list_filter(t[:-2], lambda x: length(x) = 1), '')) > 1 THEN array_to_string(list_filter(t[:-2], lambda x: length(x) = 1), '') || ' ' || t[-1] ELSE '' END,
  CASE WHEN len(t) > 1 AND trim(regexp_extract(label, '(?s)^([^,]*),', 1), ' ') <> '' AND trim(regexp_extract(label, '(?s)^[^,]*,(.*)$', 1), ' ') <> ''
    THEN trim(regexp_extract(label, '(?s)^[^,]*,(.*)$', 1), ' ') || ' ' || trim(regexp_extract(label, '(?s)^([^,]*),', 1), ' ') ELSE '' END] AS v FROM w),
f AS (SELECT entity_id, list_filter(v, lambda x: x <> '') AS v FROM v)
SELECT entity_id, array_to_string(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i), '|') AS variants FROM f""")
def plain_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The spellings of labels whose marks are left in, which SQL can tell; name_variants has all."""
    c = resolve.with_normal(table(spark, folder, "candidate").filter("label IS NOT NULL").select("entity_id", "label").distinct(), "label", "n", marks=False)
    return c.select("entity_id", F.array_join(names.variants(F.col("label"), F.col("label"), F.col("n")), "|").alias("variants"))


@query()
def name_variants(spark: SparkSession, folder: str) -> DataFrame:
    c = resolve.with_normal(_intakes(spark, folder), "name", "n").withColumn("bare", names.strip_marks(F.col("name")))
    return c.select("intake_id", F.posexplode(names.variants(F.col("name"), F.col("bare"), F.col("n"))).alias("place", "variant"))


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    i, c = _intakes(spark, folder).select("intake_id", "name"), _candidates(spark, folder).select("entity_id", "label")
    return resolve.matched(resolve.recall(i, "intake_id", "name", c, "entity_id", "label"), i, c, "intake_id", "entity_id", "name", "label")


@query()
def match_label(spark: SparkSession, folder: str) -> DataFrame:
    """Every tier of agreement of names that share a spelling; a brute-force test holds the values (SQL has no Ratcliff-Obershelp)."""
    return _matched(spark, folder).select("intake_id", "entity_id", "label_score", "how")


@query()
def rejected_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Of candidates that a loose search finds, by the last word of a name, those of another name."""
    last = F.element_at(names.name_tokens(F.col("n")), -1)
    i, c = _intakes(spark, folder).select("intake_id", "name"), _candidates(spark, folder).select("entity_id", "label")
    a, b = (resolve.with_normal(x, t, "n").filter("n <> ''").select(k, last.alias("last")) for x, k, t in ((i, "intake_id", "name"), (c, "entity_id", "label")))
    pairs = a.join(b, "last").select("intake_id", "entity_id")
    return resolve.rejected(resolve.matched(pairs, i, c, "intake_id", "entity_id", "name", "label"), "intake_id", "entity_id", "label")


@query()
def best_label(spark: SparkSession, folder: str) -> DataFrame:
    """Of each cached item's labels and aliases the one closest to its candidate's label."""
    told = _items(spark, folder).select("item", F.posexplode(extract.item_labels(F.to_json("x"))).alias("place", "other"))
    told = told.groupBy("item", "other").agg(F.min("place").alias("place"))
    j = told.join(_candidates(spark, folder).select(F.col("entity_id").alias("item"), "label"), "item")
    return resolve.best_labels(j, "item", "label", "other", "place").withColumnRenamed("label", "closest")


_CLASS = lambda r: rf"[\x{{{r[0]:04X}}}-\x{{{r[1]:04X}}}]"
_LISTED = "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in names.SCRIPTS.values())


@query(
    r"WITH c AS (SELECT DISTINCT entity_id, regexp_replace(label, '[^\p{L}]', '', 'g') AS s FROM candidate WHERE label IS NOT NULL), m AS (SELECT entity_id, ["
    + ", ".join(f"{{n: length(regexp_replace(s, '{_CLASS(r).replace('[', '[^', 1)}', '', 'g')), pos: -strpos(s, nullif(regexp_extract(s, '{_CLASS(r)}'), '')), script: '{k}'}}" for k, r in names.SCRIPTS.items())
    + f", {{n: length(regexp_replace(s, '[{_LISTED}]', '', 'g')), pos: -strpos(s, nullif(regexp_extract(s, '[^{_LISTED}]'), '')), script: 'latin'}}] AS m FROM c),"
    + " b AS (SELECT entity_id, list_sort(list_filter(m, lambda x: x.n > 0), 'DESC')[1].script AS script FROM m), l(script, langs) AS (VALUES "
    + ", ".join(f"('{k}', {v})" for k, v in names.SCRIPT_LANGUAGES.items())
    + ") SELECT entity_id, l.script, array_to_string(CASE WHEN list_contains(langs, 'en') THEN langs ELSE list_append(langs, 'en') END, ',') AS languages FROM b JOIN l ON l.script = coalesce(b.script, 'latin')"
)
def name_scripts(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "candidate").filter("label IS NOT NULL").select("entity_id", "label").distinct()
    return c.select("entity_id", names.script_of(F.col("label")).alias("script"), F.array_join(names.search_languages(F.col("label")), ",").alias("languages"))


#: Languages by country, for the invented ids of the test tables.
SPOKEN = {"Q970001": ["hi", "ta", "te", "bn", "mr"], "Q970004": ["en", "fr"], "Q970010": ["fr"], "Q970011": ["de"], "Q970012": ["es"], "Q970007": ["ja"], "Q970022": ["ru"]}


@query(f"""WITH s(country, spoken) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in SPOKEN.items())}), i AS (SELECT DISTINCT intake_id, name, country FROM intake WHERE name IS NOT NULL AND regexp_full_match(name, '[\\x00-\\x{{24F}}]*')),
l AS (SELECT intake_id, list_concat(list_concat(['en'], coalesce(spoken, [])), ['en']) AS l FROM i LEFT JOIN s USING (country))
SELECT intake_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[:3], ',') AS editions FROM l""")
def editions_for(spark: SparkSession, folder: str) -> DataFrame:
    """Editions to search for requests whose names are Latin."""
    i = table(spark, folder, "intake").filter(F.col("name").rlike(r"^[\x00-\x{24F}]*$")).select("intake_id", "name", "country").distinct()
    return i.select("intake_id", F.array_join(names.languages_for(F.col("name"), F.col("country"), SPOKEN), ",").alias("editions"))


# -- items of the knowledge graph --------------------------------------------------------------------------------------

#: The properties that the test tables' items use in place of the true ones.
PROPERTIES = {"P9345": "P345", "P9003": "P2003", "P9002": "P2002", "P9106": "P4985"}
_ITEMS_SQL = """c AS (SELECT DISTINCT url_hash, CAST(body AS JSON) AS j FROM http_cache WHERE kind = 'json' AND json_valid(body) AND json_type(body, '$.entities') = 'OBJECT'),
i AS (SELECT url_hash, k AS item, json_extract(j, '$.entities."' || k || '"') AS x FROM (SELECT url_hash, j, unnest(json_keys(j, '$.entities')) AS k FROM c)),
p AS (SELECT url_hash, item, p AS property, json_extract(x, '$.claims."' || p || '"') AS s FROM (SELECT url_hash, item, x, unnest(json_keys(x, '$.claims')) AS p FROM i WHERE json_type(x, '$.claims') = 'OBJECT')),
s AS (SELECT url_hash, item, property, generate_subscripts(s, 1) - 1 AS place, unnest(s) AS v FROM (SELECT url_hash, item, property, CAST(s AS JSON[]) AS s FROM p))"""


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """url_hash, item, x: every item of the cached answers."""
    pages = table(spark, folder, "http_cache").filter("kind = 'json' AND body IS NOT NULL").select("url_hash", "body").distinct().select("url_hash", F.try_parse_json("body").alias("v"))
    return pages.select("url_hash", F.explode(F.try_variant_get("v", "$.entities", "map<string,variant>")).alias("item", "x"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """key (answer and item), and the item as text with its properties put back."""
    x = F.to_json("x")
    for given, true in PROPERTIES.items():
        x = F.replace(x, F.lit(f'"{given}"'), F.lit(f'"{true}"'))
    return _items(spark, folder).select(F.concat_ws("/", "url_hash", "item").alias("key"), x.alias("item"))


@query(f"WITH {_ITEMS_SQL} SELECT url_hash, item, property, string_agg(v->>'$.mainsnak.datavalue.value.id', ',' ORDER BY place) AS ids FROM s WHERE json_type(v, '$.mainsnak.datavalue.value.id') = 'VARCHAR' GROUP BY 1, 2, 3")
def item_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids an item states, by property, in order."""
    t = _items(spark, folder).select("url_hash", "item", F.to_json("x").alias("t"))
    each = F.array(*[F.struct(F.lit(p).alias("property"), F.array_join(extract.item_ids(F.col("t"), p), ",").alias("ids")) for p in ("P9002", "P9003", "P9031", "P9106", "P9345", "P9569", "P9570")])
    return t.select("url_hash", "item", F.explode(each).alias("e")).select("url_hash", "item", "e.*").filter("ids <> ''")


@query(f"WITH {_ITEMS_SQL} SELECT DISTINCT url_hash, item FROM s WHERE property = 'P9031' AND v->>'$.mainsnak.datavalue.value.id' IN (SELECT occupation FROM role_ref WHERE bucket = 'athlete')")
def items_of_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Items that are of a kind: the filter that keeps humans, here for the occupations of one bucket."""
    t = _items(spark, folder).select("url_hash", "item", F.explode(extract.item_ids(F.to_json("x"), "P9031")).alias("occupation"))
    kinds = table(spark, folder, "role_ref").filter("bucket = 'athlete'").select("occupation")  # 39 rows
    return t.join(F.broadcast(kinds), "occupation", "left_semi").select("url_hash", "item").distinct()


@query(f"WITH {_ITEMS_SQL} SELECT url_hash, item, CAST(regexp_extract(v->>'$.mainsnak.datavalue.value.time', '^[+]?(-?[0-9]{{1,4}})-', 1) AS INT) AS year FROM s WHERE property = 'P9569' AND place = 0 AND regexp_matches(v->>'$.mainsnak.datavalue.value.time', '^[+]?-?[0-9]{{1,4}}-')")
def item_years(spark: SparkSession, folder: str) -> DataFrame:
    return _items(spark, folder).select("url_hash", "item", extract.item_year(F.to_json("x"), "P9569").alias("year")).filter("year IS NOT NULL")


_AUTHORITY_OF = {p: next(a[0] for a in reversed(authorities.AUTHORITIES) if a[2] == true) for p, true in PROPERTIES.items()}
_STRINGS_SQL = f"""{_ITEMS_SQL}, a(property, authority) AS (VALUES {_values(_AUTHORITY_OF)}),
t AS (SELECT url_hash || '/' || item AS key, item, property, authority, place, v->>'$.mainsnak.datavalue.value' AS value FROM s JOIN a USING (property) WHERE json_type(v, '$.mainsnak.datavalue.value') = 'VARCHAR')"""


@query(f"WITH {_STRINGS_SQL} SELECT key, authority, arg_max(value, place) AS id FROM t GROUP BY 1, 2")
def external_ids(spark: SparkSession, folder: str) -> DataFrame:
    return claims.external_ids(_texts(spark, folder), "key", "item")


_ITEM_CLAIMS_SQL = f"""WITH {_STRINGS_SQL}, l AS (SELECT url_hash || '/' || item AS key, k AS site, x->>('$.sitelinks."' || k || '".title') AS title FROM (SELECT url_hash, item, x, unnest(json_keys(x, '$.sitelinks')) AS k FROM i WHERE json_type(x, '$.sitelinks') = 'OBJECT'))
SELECT key, authority AS platform, value AS handle, 'handle' AS id_kind, '' AS lang, 1 AS tier, 'wikidata:' || CASE property {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PROPERTIES.items())} END AS source, authority = 'imdb' AS authoritative FROM t WHERE authority IN ('imdb', 'instagram', 'twitter')
UNION ALL SELECT key, 'wikipedia', title, 'page_title', replace(regexp_replace(site, 'wiki$', ''), '_', '-'), 1, 'wikidata:sitelink:' || site, TRUE FROM l WHERE site LIKE '%wiki' AND site NOT IN ('commonswiki', 'specieswiki') AND coalesce(title, '') <> ''"""


@query(_ITEM_CLAIMS_SQL)
def item_claims(spark: SparkSession, folder: str) -> DataFrame:
    return claims.item_claims(_texts(spark, folder), "key", "item").select("key", *claims.COLUMNS)


# -- claims out of pages, relations and records ------------------------------------------------------------------------

_URL_SQL = """CASE platform WHEN 'facebook' THEN 'https://www.facebook.com/' || handle WHEN 'instagram' THEN 'https://www.instagram.com/' || handle || '/' WHEN 'twitter' THEN 'https://x.com/' || handle
  WHEN 'youtube' THEN 'https://www.youtube.com/@' || handle WHEN 'tiktok' THEN 'https://www.tiktok.com/@' || handle WHEN 'linkedin' THEN 'https://www.linkedin.com/in/' || handle || '/'
  WHEN 'imdb' THEN 'https://www.imdb.com/name/' || lower(handle) || '/' WHEN 'wikipedia' THEN 'https://' || lang || '.wikipedia.org/wiki/' || handle END"""
#: What the URLs of the accounts of table handle are classified as: an imdb id that is none is no account.
_REFS_SQL = """h AS (SELECT DISTINCT entity_id, handle_id, platform, CASE platform WHEN 'wikipedia' THEN replace(handle, '_', ' ') ELSE handle END AS handle, CASE platform WHEN 'wikipedia' THEN 'page_title' ELSE 'handle' END AS id_kind,
  CASE platform WHEN 'wikipedia' THEN lang ELSE '' END AS lang, verdict FROM handle WHERE platform <> 'imdb'),
r AS (SELECT *, platform || ':' || lower(handle) || CASE WHEN lang <> '' THEN '@' || lang ELSE '' END AS ref_key FROM h)"""


def _accounts(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "handle").select("entity_id", "handle_id", "platform", "handle", "lang", "verdict").distinct()
    return h.withColumn("url", urls.build_url(F.col("platform"), F.col("handle"), F.nullif("lang", F.lit(""))))


def _anchors(df: DataFrame, *by: str) -> DataFrame:
    """A page for each key: an anchor for each account, in the order of handle_id."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("handle_id", "url"))), lambda x: F.concat(F.lit("<a class=link href='"), x["url"], F.lit("'>x</a>")))
    return df.groupBy(*by).agg(F.concat(F.lit("<html><body>"), F.array_join(listed, "\n"), F.lit("</body></html>")).alias("body"))


@query(f"WITH {_REFS_SQL}, f AS (SELECT DISTINCT ON (entity_id, ref_key) entity_id, handle_id, platform, handle, lang FROM r ORDER BY entity_id, ref_key, handle_id) SELECT entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY handle_id) - 1 AS INT) AS place, platform, handle, lang FROM f")
def harvest_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The accounts a page links to, out of a page for each entity."""
    pages = _anchors(_accounts(spark, folder), "entity_id")
    return pages.select("entity_id", F.posexplode(extract.harvest(F.col("body"))).alias("place", "r")).select("entity_id", "place", "r.platform", "r.handle", F.coalesce("r.lang", F.lit("")).alias("lang"))


@query(f"WITH {_REFS_SQL} SELECT entity_id, count(DISTINCT platform) FILTER (platform <> 'imdb') >= 3 AS aggregator FROM (SELECT entity_id, platform FROM r UNION ALL SELECT entity_id, platform FROM handle WHERE platform = 'imdb') GROUP BY 1")
def aggregator_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _anchors(_accounts(spark, folder), "entity_id").select("entity_id", extract.looks_like_aggregator(F.col("body"), words=400_000).alias("aggregator"))


@query(f"WITH {_REFS_SQL} SELECT DISTINCT entity_id, platform, handle, id_kind, lang, 1 AS tier, 'musicbrainz:' || verdict AS source, FALSE AS authoritative FROM r")
def relation_claims(spark: SparkSession, folder: str) -> DataFrame:
    a = _accounts(spark, folder)
    return claims.relation_claims(a.withColumn("kind", F.col("verdict")), "entity_id", "url", "kind").distinct()


_LD = ("<script type='application/ld+json'>", "</script>")


@query(f"WITH {_REFS_SQL} SELECT DISTINCT entity_id, platform, handle, id_kind, lang, 2 AS tier, 'schema.org:sameAs' AS source, FALSE AS authoritative FROM r")
def same_as_claims(spark: SparkSession, folder: str) -> DataFrame:
    said = _accounts(spark, folder).groupBy("entity_id").agg(F.to_json(F.struct(F.struct(F.collect_list("url").alias("sameAs")).alias("about"))).alias("ld"))
    return claims.same_as_claims(said.select("entity_id", F.concat(F.lit("<html>" + _LD[0]), "ld", F.lit(_LD[1] + "</html>")).alias("html")), "entity_id", "html").distinct()


_SERVICES = ["linktr.ee", "bio.link", "solo.to", "komi.io", "hoo.be", "tap.bio"]


@query(f"WITH {_REFS_SQL} SELECT DISTINCT entity_id, platform, handle, id_kind, lang, 2 AS tier, 'aggregator' AS source, FALSE AS authoritative FROM r WHERE handle_id % 6 < 4")
def cascade(spark: SparkSession, folder: str) -> DataFrame:
    """From a seed page with six link-in-bio pages: the accounts the first four name."""
    at = lambda k: F.concat(F.lit("https://"), F.element_at(F.array(*map(F.lit, _SERVICES)), k), F.lit("/"), F.col("entity_id"))
    a = _accounts(spark, folder)
    pages = _anchors(a.withColumn("place", (F.col("handle_id") % 6 + 1).cast("int")), "entity_id", "place").select(at(F.col("place")).alias("url"), "body")
    links = F.concat(*[F.concat(F.lit("<a href='"), at(F.lit(k)), F.lit("'>page</a>")) for k in range(1, 7)])
    return claims.cascade(a.select("entity_id").distinct().select("entity_id", links.alias("html")), "entity_id", "html", pages).distinct()


@query(f"""WITH {_REFS_SQL}, f AS (SELECT entity_id, ref_key, any_value(platform) AS platform, min(handle_id) AS handle_id, any_value(handle) AS handle, any_value(id_kind) AS id_kind, any_value(lang) AS lang FROM (SELECT DISTINCT ON (entity_id, ref_key) * FROM r ORDER BY entity_id, ref_key, handle_id) GROUP BY 1, 2),
l AS (SELECT entity_id, ref_key, platform AS src, lead(handle_id) OVER w AS nxt FROM f WINDOW w AS (PARTITION BY entity_id ORDER BY handle_id))
SELECT DISTINCT f.entity_id, f.platform, f.handle, f.id_kind, f.lang, 3 AS tier, 'backlink_from:' || l.src AS source, FALSE AS authoritative FROM l JOIN f ON f.entity_id = l.entity_id AND f.handle_id = l.nxt""")
def back_links(spark: SparkSession, folder: str) -> DataFrame:
    """Each account's page links to the entity's next one, and to a stranger."""
    from pyspark.sql import Window

    a = _accounts(spark, folder).filter("platform <> 'imdb'").withColumn("handle", F.when(F.col("platform") == "wikipedia", F.replace("handle", F.lit("_"), F.lit(" "))).otherwise(F.col("handle")))
    a = a.withColumn("ref_key", urls.ref_key(F.col("platform"), F.col("handle"), F.when(F.col("platform") == "wikipedia", F.col("lang"))))
    known = ranking.first_of(a.select("entity_id", "ref_key", "handle_id", "platform", "url"), ["entity_id", "ref_key"], ["handle_id"])
    own = F.concat("url", F.lit("?of="), "entity_id")  # one account may be of several entities, each with its own page
    nxt = F.lead("url").over(Window.partitionBy("entity_id").orderBy("handle_id"))
    pages = known.select(own.alias("url"), F.concat(F.lit("<p><a href='https://www.instagram.com/stranger/'>s</a> <a href='"), F.coalesce(nxt, F.lit("#")), F.lit("'>n</a>")).alias("body"))
    return claims.back_link_claims(known.withColumn("url", own), "entity_id", pages).distinct()


_FIELD_SQL = ", ".join(f"max(CASE WHEN platform = '{p}' THEN '@' || handle END) AS {f}" for f, p in claims.FIELDS.items())
_RECORDS_SQL = f"""WITH r AS (SELECT entity_id, {_FIELD_SQL} FROM handle GROUP BY 1), g AS (SELECT entity_id, bool_or(map_contains(external_ids, 'tmdb_person')) AS graph FROM candidate GROUP BY 1),
u AS (UNPIVOT (SELECT r.*, coalesce(graph, FALSE) AS graph FROM r LEFT JOIN g USING (entity_id)) ON {', '.join(claims.FIELDS)} INTO NAME field VALUE value)
SELECT entity_id, regexp_replace(field, '_id$', '') AS platform, substr(value, 2) AS handle, 'handle' AS id_kind, '' AS lang, CASE WHEN graph THEN 1 ELSE 4 END AS tier, 'tmdb:' || field AS source, graph AND field = 'imdb_id' AS authoritative FROM u"""


@query(_RECORDS_SQL)
def record_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts out of external-id records, one a person."""
    h = table(spark, folder, "handle")
    records = h.groupBy("entity_id").agg(*[F.max(F.when(F.col("platform") == p, F.concat(F.lit("@"), "handle"))).alias(f) for f, p in claims.FIELDS.items()])
    graph = table(spark, folder, "candidate").groupBy("entity_id").agg(F.bool_or(F.map_contains_key("external_ids", "tmdb_person")).alias("graph"))
    j = records.join(graph, "entity_id", "left").withColumn("graph", F.coalesce("graph", F.lit(False)))
    return claims.record_claims(j, "entity_id", "graph").select("entity_id", *claims.COLUMNS)


_CONFIDENCE = """g AS (SELECT entity_id, ref_key, count(tier) AS n_evidence, min(tier) AS best_tier, bool_or(authoritative) AS auth, count(*) FILTER (tier = 1) AS t1, count(*) FILTER (tier = 2) AS t2, count(*) FILTER (tier = 3) AS t3, count(*) FILTER (tier = 4) AS t4, count(*) FILTER (tier = 5) AS t5 FROM e GROUP BY 1, 2),
c AS (SELECT *, 1.0::DOUBLE - (((((1.0::DOUBLE * CASE WHEN t1 > 0 THEN 1.0::DOUBLE - 0.55::DOUBLE ELSE 1.0::DOUBLE END) * CASE WHEN t2 > 0 THEN 1.0::DOUBLE - 0.45::DOUBLE ELSE 1.0::DOUBLE END)
  * CASE WHEN t3 > 0 THEN 1.0::DOUBLE - 0.78::DOUBLE ELSE 1.0::DOUBLE END) * CASE WHEN t4 > 0 THEN 1.0::DOUBLE - 0.38::DOUBLE ELSE 1.0::DOUBLE END))
  + ((((CASE WHEN t1 > 1 THEN 0.03::DOUBLE * least(t1 - 1, 2) ELSE 0.0::DOUBLE END) + CASE WHEN t2 > 1 THEN 0.03::DOUBLE * least(t2 - 1, 2) ELSE 0.0::DOUBLE END)
  + CASE WHEN t3 > 1 THEN 0.03::DOUBLE * least(t3 - 1, 2) ELSE 0.0::DOUBLE END) + CASE WHEN t4 > 1 THEN 0.03::DOUBLE * least(t4 - 1, 2) ELSE 0.0::DOUBLE END) AS raw FROM g),
f AS (SELECT *, round(least(CASE WHEN auth AND raw < 0.8 THEN 0.8::DOUBLE ELSE raw END, 0.99::DOUBLE), 3) AS confidence FROM c),
v AS (SELECT entity_id, ref_key, n_evidence, best_tier, confidence, CASE WHEN t5 > 0 AND t1 + t2 + t3 + t4 = 0 THEN 'reject' WHEN confidence >= 0.75 THEN 'accept' WHEN confidence >= 0.35 THEN 'review' ELSE 'reject' END AS verdict FROM f)"""
_ALL_SQL = f"""WITH e0 AS (SELECT split_part(key, '/', 2) AS entity_id, platform, handle, lang, tier, authoritative FROM ({_ITEM_CLAIMS_SQL})
  UNION ALL SELECT entity_id, platform, handle, lang, tier, authoritative FROM ({_RECORDS_SQL})
  UNION ALL SELECT entity_id, platform, handle, lang, tier, authoritative FROM ({{relations}}) UNION ALL SELECT entity_id, platform, handle, lang, tier, authoritative FROM ({{same_as}})
  UNION ALL SELECT entity_id, platform, handle, lang, tier, authoritative FROM ({{cascade}}) UNION ALL SELECT entity_id, platform, handle, lang, tier, authoritative FROM ({{back}})),
e AS (SELECT *, platform || ':' || lower(handle) || CASE WHEN lang <> '' THEN '@' || lang ELSE '' END AS ref_key FROM e0), {_CONFIDENCE}"""


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence of all six sources."""
    items = item_claims(spark, folder).withColumn("entity_id", F.split_part("key", F.lit("/"), F.lit(2)))
    return claims.union([items, *[f(spark, folder) for f in (record_claims, relation_claims, same_as_claims, cascade, back_links)]], "entity_id")


def _with_all(sql: str) -> str:
    return _ALL_SQL.format(relations=_SQL["relation_claims"], same_as=_SQL["same_as_claims"], cascade=_SQL["cascade"], back=_SQL["back_links"]) + sql


@query(_with_all(" SELECT * FROM v"))
def account_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence and verdict of every account over the evidence of items, records, relations, pages, cascades and back links."""
    return evidence.claim_confidence(_evidence(spark, folder), ["entity_id", "ref_key"])


@query(_with_all(" SELECT entity_id, round(count(DISTINCT CASE WHEN verdict = 'accept' THEN split_part(ref_key, ':', 1) END) / 8.0::DOUBLE, 3) AS coverage FROM v GROUP BY 1"))
def account_coverage(spark: SparkSession, folder: str) -> DataFrame:
    v = account_verdicts(spark, folder).withColumn("platform", F.split_part("ref_key", F.lit(":"), F.lit(1)))
    return evidence.coverage(v, "entity_id")


# -- lookups -----------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT DISTINCT handle_id, platform, upper(handle) AS handle FROM handle UNION ALL SELECT DISTINCT -intake_id, k, known_handles[k] FROM (SELECT intake_id, known_handles, unnest(map_keys(known_handles)) AS k FROM intake)),
f AS (SELECT platform, lower(handle) AS h, arg_min(entity_id, handle_id) AS entity_id FROM handle GROUP BY 1, 2)
SELECT a.handle_id AS asked, a.platform, f.entity_id FROM a LEFT JOIN f ON f.platform = a.platform AND f.h = lower(a.handle)""")
def handle_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Whose account it is: accounts in capitals, and the old ones of requests."""
    h = table(spark, folder, "handle")
    asked = h.select(F.col("handle_id").alias("asked"), "platform", F.upper("handle").alias("handle")).distinct()
    old = table(spark, folder, "intake").select((-F.col("intake_id")).alias("asked"), F.explode("known_handles").alias("platform", "handle")).distinct()
    return claims.lookup_handles(asked.unionByName(old), h, "handle_id").select("asked", "platform", "entity_id")


_REGISTRY_SQL = """c AS (SELECT DISTINCT ON (entity_id) entity_id, label, roles FROM candidate WHERE label IS NOT NULL),
n AS (SELECT label, count(*) AS n_candidates FROM c GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT label, n_candidates, coalesce((SELECT string_agg(DISTINCT r, ',' ORDER BY r) FROM (SELECT label AS l, unnest(roles) AS r FROM c) x WHERE x.l = n.label), '') AS roles FROM n)"""


@query(f"WITH {_REGISTRY_SQL}, k AS (SELECT lower(label) AS k, arg_max({{n: n_candidates, r: roles}}, {{n: n_candidates, l: label}}) AS v FROM g GROUP BY 1) SELECT DISTINCT intake_id, k.v.n AS n_candidates, k.v.r AS roles FROM intake LEFT JOIN k ON k.k = lower(name)")
def known_collisions(spark: SparkSession, folder: str) -> DataFrame:
    registry = store.collisions(_candidates(spark, folder), "label", "roles")
    return claims.lookup_collisions(table(spark, folder, "intake").select("intake_id", "name").distinct(), "name", registry, "label").select("intake_id", "n_candidates", "roles")


@query(f"WITH {_REGISTRY_SQL} SELECT label, n_candidates, roles FROM g")
def collision_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The registry of the candidates of one authority, with all that is known of all of them in place of it."""
    c = _candidates(spark, folder)
    return store.upsert(store.collisions(c.filter("entity_id LIKE 'Q%'"), "label", "roles"), store.collisions(c, "label", "roles"), ["label"])


@query("""WITH a AS (SELECT entity_id, lang, handle, row_number() OVER (PARTITION BY entity_id ORDER BY handle_id) AS place FROM (SELECT DISTINCT entity_id, lang, handle, handle_id FROM handle WHERE platform = 'wikipedia')),
i AS (SELECT DISTINCT lang || 'wiki' AS site, replace(handle, '_', ' ') AS title, CASE WHEN entity_id LIKE 'Q%' THEN entity_id ELSE 'Q' || entity_id END AS item FROM handle WHERE platform = 'wikipedia')
SELECT entity_id, item, min(place)::INT AS place FROM a JOIN i ON i.site = a.lang || 'wiki' AND i.title = replace(a.handle, '_', ' ') WHERE place <= 3 GROUP BY 1, 2""")
def article_items(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    h = table(spark, folder, "handle").filter("platform = 'wikipedia'").select("entity_id", "lang", "handle", "handle_id").distinct()
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("handle_id"))
    articles = h.select("entity_id", urls.build_url(F.lit("wikipedia"), F.col("handle"), F.col("lang")).alias("url"), place.alias("place"))
    item = F.when(F.col("entity_id").like("Q%"), F.col("entity_id")).otherwise(F.concat(F.lit("Q"), "entity_id"))
    items = h.select(F.concat("lang", F.lit("wiki")).alias("site"), F.replace("handle", F.lit("_"), F.lit(" ")).alias("title"), item.alias("item")).distinct()
    return claims.article_items(articles, "entity_id", "url", "place", items)


@query("""SELECT DISTINCT doc_id, lower(regexp_extract(trim(url), '^[^:/?#]*://([^/?#:]*)', 1)) AS host,
  regexp_matches(lower(regexp_extract(trim(url), '^[^:/?#]*://([^/?#:]*)', 1)), '(^|[.])(""" + "|".join(d.replace(".", "[.]") for d in urls.ALLOWED) + """)$') AS allowed FROM documents WHERE url IS NOT NULL""")
def allowed_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("url IS NOT NULL").select("doc_id", urls.host(F.col("url")).alias("host"), urls.is_allowed(F.col("url")).alias("allowed")).distinct()


@query(f"SELECT DISTINCT handle_id, 'https://' || d || '/' || handle AS url FROM (SELECT handle_id, handle, unnest({urls.AGGREGATORS}) AS d FROM handle WHERE regexp_full_match(handle, '[A-Za-z0-9._-]{{2,40}}'))")
def probe_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "handle").select("handle_id", "handle").distinct().select("handle_id", F.explode(urls.probe_urls(F.col("handle"))).alias("url"))


@query("""SELECT DISTINCT handle_id, lang || 'wiki' AS site, CASE handle_id % 3 WHEN 0 THEN replace(handle, '_', ' ') WHEN 1 THEN replace(handle, '_', ' ') || '/a b' END AS title FROM handle WHERE platform = 'wikipedia' AND handle_id % 3 < 2""")
def article_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Articles, pages below them, and pages of a namespace, which are no articles."""
    h = table(spark, folder, "handle").filter("platform = 'wikipedia'").select("handle_id", "handle", "lang").distinct()
    tail = F.when(F.col("handle_id") % 3 == 0, F.col("handle")).when(F.col("handle_id") % 3 == 1, F.concat("handle", F.lit("/a%20b?x=1#y"))).otherwise(F.concat(F.lit("Draft:"), "handle"))
    return h.select("handle_id", urls.wikipedia_site(F.concat(F.col("lang"), F.lit(".wikipedia.org/wiki/"), tail)).alias("w")).filter("w IS NOT NULL").select("handle_id", "w.site", "w.title")


_GAP_SQL = "CASE " + " ".join(f"WHEN host LIKE '%{h}' THEN {g}" for h, g in urls.HOST_GAPS.items()) + f" ELSE {urls.DEFAULT_GAP} END"


@query(f"""WITH c AS (SELECT DISTINCT url_hash, fetched_at, lower(regexp_extract(url, '^[^:/?#]*://([^/?#:]*)', 1)) AS host FROM http_cache WHERE url IS NOT NULL),
g AS (SELECT url_hash, host, epoch_us(fetched_at) - epoch_us(lag(fetched_at) OVER (PARTITION BY host ORDER BY fetched_at, url_hash)) AS gap FROM c)
SELECT url_hash, host, gap / 1e6 AS gap FROM g WHERE gap < 3600 * 1e6 * {_GAP_SQL}""")
def throttle_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Calls that came sooner after the one before to their host than its gap allows, with gaps in hours in place of seconds."""
    c = table(spark, folder, "http_cache").filter("url IS NOT NULL").select("url_hash", urls.host(F.col("url")).alias("host"), F.col("fetched_at").cast("timestamp").alias("at")).distinct()
    return store.gaps(c, "host", ["at", "url_hash"], urls.host_gap(F.col("host")) * 3600).select("url_hash", "host", "gap")


# -- searches ----------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT entity_id, lang, handle, row_number() OVER (PARTITION BY entity_id, lang ORDER BY handle_id) AS k FROM (SELECT DISTINCT entity_id, lang, handle, handle_id FROM handle WHERE platform = 'wikipedia')),
f AS (SELECT entity_id, min(lang) AS lang FROM t GROUP BY 1)
SELECT entity_id, (row_number() OVER (PARTITION BY entity_id ORDER BY min(k)) - 1)::INT AS rank, 'https://' || lang || '.wikipedia.org/wiki/' || handle AS link FROM t JOIN f USING (entity_id, lang) WHERE k <= 5 GROUP BY entity_id, lang, handle""")
def article_search(spark: SparkSession, folder: str) -> DataFrame:
    """Of several editions the articles of the first that answers."""
    h = table(spark, folder, "handle").filter("platform = 'wikipedia'").select("entity_id", "lang", "handle", "handle_id").distinct()
    hits = F.transform(F.array_sort(F.collect_list(F.struct("handle_id", "handle"))), lambda x: F.struct(F.replace(x["handle"], F.lit("_"), F.lit(" ")).alias("title")))
    answers = h.groupBy("entity_id", "lang").agg(F.to_json(F.struct(F.struct(hits.alias("search")).alias("query"))).alias("body"))
    answers = answers.unionByName(h.select("entity_id").distinct().select("entity_id", F.lit("aa").alias("lang"), F.lit('{"query":{"search":[]}}').alias("body")))
    return discovery.first_answering(answers.withColumn("links", discovery.article_titles(F.col("body"), F.col("lang"))), "entity_id", "lang", "links").select("entity_id", "rank", "link")


_GROUPED_SQL = "g AS (SELECT DISTINCT ON (entity_id) citizenship[1] AS country, entity_id, birth_year FROM candidate WHERE len(citizenship) > 0)"


def _answers(spark: SparkSession, folder: str, element: Column, wrap) -> DataFrame:
    c = table(spark, folder, "candidate").dropDuplicates(["entity_id"]).filter("size(citizenship) > 0").withColumn("country", F.element_at("citizenship", 1))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("entity_id", element.alias("e")))), lambda x: x["e"])
    return c.groupBy("country").agg(F.to_json(wrap(listed)).alias("body"))


@query(f"WITH {_GROUPED_SQL} SELECT country, coalesce(string_agg(entity_id, ',' ORDER BY entity_id) FILTER (birth_year % 100 >= 85), '') AS ids FROM g GROUP BY 1")
def artist_search(spark: SparkSession, folder: str) -> DataFrame:
    """Artists a catalogue is sure of."""
    a = _answers(spark, folder, F.struct(F.col("entity_id").alias("id"), (F.col("birth_year") % 100).alias("score")), lambda x: F.struct(x.alias("artists")))
    return a.select("country", F.array_join(discovery.artist_ids(F.col("body")), ",").alias("ids"))


@query(f"WITH {_GROUPED_SQL}, l AS (SELECT country, list(CASE WHEN birth_year % 3 <> 0 THEN entity_id END ORDER BY entity_id) AS l FROM g GROUP BY 1) SELECT country, array_to_string(list_filter(l, lambda x: x IS NOT NULL)[:3], ',') AS authors, array_to_string(list_filter(l[:3], lambda x: x IS NOT NULL), ',') AS clusters FROM l")
def author_search(spark: SparkSession, folder: str) -> DataFrame:
    """The first keys of authors that have one, and the keys that the first clusters have."""
    key = F.when(F.col("birth_year") % 3 != 0, F.col("entity_id"))
    a = _answers(spark, folder, F.struct(key.alias("key")), lambda x: F.struct(x.alias("docs")))
    b = _answers(spark, folder, F.struct(key.alias("viafid")), lambda x: F.struct(x.alias("result")))
    told = a.select("country", F.array_join(discovery.author_keys(F.col("body")), ",").alias("authors"))
    return told.join(b.select("country", F.array_join(discovery.cluster_ids(F.col("body")), ",").alias("clusters")), "country")


@query("""WITH p AS (SELECT entity_id, min(handle) FILTER (platform = 'instagram') AS instagram, min(handle) FILTER (platform = 'twitter') AS twitter, min(handle) FILTER (platform = 'facebook') AS facebook, min(handle) FILTER (platform = 'youtube') AS youtube FROM handle GROUP BY 1)
SELECT entity_id, platform, handle FROM (UNPIVOT p ON instagram, twitter, facebook, youtube INTO NAME platform VALUE handle)""")
def player_search(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts out of five columns of a player's record."""
    own = lambda p: F.min(F.when(F.col("platform") == p, F.col("handle")))
    p = table(spark, folder, "handle").groupBy("entity_id").agg(*[own(x).alias(x) for x in ("instagram", "twitter", "facebook", "youtube")])
    fields = F.struct(F.concat(F.lit("www.instagram.com/"), "instagram").alias("strInstagram"), F.concat(F.lit("https://twitter.com/"), "twitter").alias("strTwitter"), F.concat(F.lit("facebook.com/"), "facebook").alias("strFacebook"), F.concat(F.lit("youtube.com/@"), "youtube").alias("strYoutube"), F.concat(F.lit("x.com/"), "twitter").alias("strWebsite"))
    bodies = p.select("entity_id", F.to_json(F.struct(F.array(fields).alias("player"))).alias("body"))
    return bodies.select("entity_id", F.explode(discovery.player_links(F.col("body"))).alias("r")).select("entity_id", "r.platform", "r.handle")


_ORDER_SQL = f"o(role, platform, turn) AS (VALUES {', '.join(f'({k!r}, {p!r}, {n})' for k, v in discovery.PRIORITY.items() for n, p in enumerate(v, 1))}), d(platform, turn) AS (VALUES {', '.join(f'({p!r}, {n})' for n, p in enumerate(discovery.PRIORITY_OF_OTHERS, 1))})"
_STAGED_SQL = f"""WITH {_REFS_SQL}, {_ORDER_SQL}, c AS (SELECT entity_id, min(label) AS name, min(roles[1]) AS role FROM candidate GROUP BY 1),
b AS (SELECT r.*, handle_id % 7 AS rank, CASE WHEN handle_id % 40 = 0 THEN 1 WHEN platform = 'wikipedia' THEN 2 ELSE 3 END AS stage, c.name, c.role FROM r JOIN c USING (entity_id)),
t AS (SELECT b.*, CASE WHEN stage = 3 THEN coalesce(o.turn, CASE WHEN b.role IS NULL OR b.role NOT IN (SELECT role FROM o) THEN d.turn END, 0) ELSE 0 END AS turn FROM b LEFT JOIN o ON o.role = b.role AND o.platform = b.platform LEFT JOIN d ON d.platform = b.platform),
w AS (SELECT * FROM t WHERE stage < 3 OR turn BETWEEN 1 AND 4), s AS (SELECT * FROM w WHERE stage = (SELECT min(stage) FROM w x WHERE x.entity_id = w.entity_id)),
k AS (SELECT DISTINCT ON (entity_id, key) entity_id, stage, platform, handle, lang, rank FROM (SELECT *, CASE WHEN stage = 1 THEN ref_key || verdict ELSE ref_key END AS key FROM s) ORDER BY entity_id, key, turn, rank)"""


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts as search results: some as hits of the first search, articles of the second, others of their platform's."""
    a = _accounts(spark, folder).filter("platform <> 'imdb'")
    c = table(spark, folder, "candidate").groupBy("entity_id").agg(F.min("label").alias("name"), F.min(F.try_element_at("roles", F.lit(1))).alias("role"))
    stage = F.when(F.col("handle_id") % 40 == 0, 1).when(F.col("platform") == "wikipedia", 2).otherwise(3)
    link = F.when(stage == 1, F.concat("url", F.lit("?v="), "verdict")).otherwise(F.col("url"))
    return a.join(c, "entity_id").select("entity_id", "name", "role", stage.alias("stage"), F.col("platform").alias("asked"), (F.col("handle_id") % 7).cast("int").alias("rank"), link.alias("link"), F.col("name").alias("title"))


@query(_STAGED_SQL + " SELECT entity_id, stage, platform, handle, lang FROM k")
def staged_search(spark: SparkSession, folder: str) -> DataFrame:
    r = discovery.staged(_results(spark, folder), "entity_id", F.col("name"), F.col("role"))
    return r.select("entity_id", "stage", "platform", "handle", F.coalesce("lang", F.lit("")).alias("lang"))


@query(_STAGED_SQL + """, m AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY stage, rank, platform, handle) AS n FROM k)
SELECT entity_id, platform, string_agg(handle, ' | ' ORDER BY n) AS handles FROM m WHERE n <= 12 GROUP BY 1, 2""")
def proposals(spark: SparkSession, folder: str) -> DataFrame:
    return discovery.by_platform(discovery.staged(_results(spark, folder), "entity_id", F.col("name"), F.col("role")), "entity_id")


@query("SELECT DISTINCT doc_id, contains(regexp_replace(lower(left(text, 200)), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(label), '[^a-z0-9]+', '', 'g')) AS named FROM documents JOIN (SELECT entity_id, min(label) AS label FROM candidate GROUP BY 1) USING (entity_id) WHERE text IS NOT NULL")
def named_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a document's beginning, taken for its title, names the person it is about."""
    d = table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", "entity_id", F.substring("text", 1, discovery.SNIPPET).alias("t")).distinct()
    c = table(spark, folder, "candidate").groupBy("entity_id").agg(F.min("label").alias("label")).filter("label IS NOT NULL")
    return d.join(c, "entity_id").select("doc_id", names.name_in_title(F.col("label"), F.col("t")).alias("named"))


_DEPARTMENT = {"actor": "Acting", "director": "Directing", "writer": "Writing", "musician": "Sound", "executive": "Production", "comedian": "Acting"}
_PEOPLE_SQL = _PAIRS_SQL + f""", dp(bucket, dept) AS (VALUES {_values(_DEPARTMENT)}), dr(dept, role) AS (VALUES {', '.join(f"('{d}', '{r}')" for d, rs in ranking.DEPARTMENTS.items() for r in rs)}),
f AS (SELECT r.intake_id, r.entity_id, round((least(coalesce(c.birth_year % 60, 0)::DOUBLE, 50.0::DOUBLE) / 50.0::DOUBLE
  + CASE WHEN coalesce(i.role, '') = '' THEN 0.0::DOUBLE WHEN EXISTS (SELECT 1 FROM dp JOIN dr USING (dept) WHERE dp.bucket = c.roles[1] AND dr.role = i.role) THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END)
  + CASE WHEN lower(trim(c.label)) = lower(trim(i.name)) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, 3) AS score FROM r JOIN c USING (entity_id) JOIN i USING (intake_id)),
w AS (SELECT *, row_number() OVER (PARTITION BY intake_id ORDER BY score DESC, entity_id) AS k, count(*) OVER (PARTITION BY intake_id) AS n, lead(score) OVER (PARTITION BY intake_id ORDER BY score DESC, entity_id) AS nxt FROM f),
z AS (SELECT *, n = 1 OR (score > 0 AND round(score - nxt, 3) >= 1.6::DOUBLE - 1.0::DOUBLE) AS clear FROM w WHERE k = 1)
SELECT intake_id, n, CASE WHEN clear THEN entity_id END AS person, round(score - nxt, 3) AS gap, CASE WHEN clear THEN 'resolved' ELSE 'ambiguous' END AS decision FROM z"""


@query(_PEOPLE_SQL)
def person_rank(spark: SparkSession, folder: str) -> DataFrame:
    """People found by name, ranked by popularity, department and very name; marks are left in names, as SQL can do."""
    pairs = _scored(spark, folder, False).select("intake_id", "entity_id")
    i = _intakes(spark, folder).select("intake_id", "name", F.col("expected_role").alias("role"))
    c = _candidates(spark, folder).select("entity_id", "label", "birth_year", F.try_element_at("roles", F.lit(1)).alias("bucket"))
    dept = F.try_element_at(F.create_map(*[F.lit(x) for kv in _DEPARTMENT.items() for x in kv]), F.coalesce("bucket", F.lit("")))
    j = pairs.join(i, "intake_id").join(c, "entity_id").withColumn("score", ranking.person_score((F.col("birth_year") % 60).cast("double"), dept, F.col("role"), F.col("label"), F.col("name")))
    return ranking.rank_people(j, "intake_id", "score", "entity_id")


@query(_PAIRS_SQL + """, w AS (SELECT *, row_number() OVER (PARTITION BY intake_id ORDER BY role_score DESC, entity_id) AS k, count(*) OVER (PARTITION BY intake_id) AS n, lead(role_score) OVER (PARTITION BY intake_id ORDER BY role_score DESC, entity_id) AS nxt FROM r)
SELECT intake_id, w.n || ' people share this name and no role hint was supplied. Add an expected role and this usually resolves on its own.' AS reason FROM w JOIN i USING (intake_id)
WHERE k = 1 AND w.n > 1 AND NOT (role_score > 0 AND round(role_score - nxt, 3) >= 0.25) AND coalesce(role, '') = ''""")
def undecided_reasons(spark: SparkSession, folder: str) -> DataFrame:
    r = ranking.rank(_scored(spark, folder, False), "intake_id", "role_score", "entity_id").join(_intakes(spark, folder).select("intake_id", "expected_role"), "intake_id")
    return ranking.with_reason(r, F.col("expected_role")).filter("reason IS NOT NULL").select("intake_id", "reason")


@query(_PAIRS_SQL + """SELECT intake_id, entity_id, k AS card, c.label, array_to_string(c.roles, ',') AS roles, c.birth_year AS born, c.death_year AS died, role_score, coalesce(len(map_keys(c.external_ids)), 0)::INT AS id_count, 'https://www.wikidata.org/wiki/' || entity_id AS page
FROM (SELECT *, row_number() OVER (PARTITION BY intake_id ORDER BY role_score DESC, entity_id) AS k FROM r) JOIN c USING (entity_id) WHERE k <= 6""")
def full_cards(spark: SparkSession, folder: str) -> DataFrame:
    top = ranking.top_k(_scored(spark, folder, False), ["intake_id"], [F.desc("role_score"), F.col("entity_id")], 6, "card")
    c = _candidates(spark, folder).select("entity_id", "label", F.array_join("roles", ",").alias("roles"), F.col("birth_year").alias("born"), F.col("death_year").alias("died"), F.coalesce(F.size(F.map_keys("external_ids")), F.lit(0)).alias("id_count"))
    return top.join(c, "entity_id").select("intake_id", "entity_id", "card", "label", "roles", "born", "died", "role_score", "id_count", F.concat(F.lit("https://www.wikidata.org/wiki/"), "entity_id").alias("page"))


_SHEET_COLUMNS = ["row_id", "name", "decision", "entity_id", "label", "roles", "coverage", "needs_review", "instagram"]


@query(_PAIRS_SQL + f""", w AS (SELECT *, row_number() OVER (PARTITION BY intake_id ORDER BY role_score DESC, entity_id) AS k, count(*) OVER (PARTITION BY intake_id) AS n, lead(role_score) OVER (PARTITION BY intake_id ORDER BY role_score DESC, entity_id) AS nxt FROM r),
d AS (SELECT intake_id, CASE WHEN n = 1 OR (role_score > 0 AND round(role_score - nxt, 3) >= 0.25) THEN entity_id END AS entity_id, n FROM w WHERE k = 1),
q AS (SELECT entity_id, coalesce(string_agg(DISTINCT CASE WHEN verdict = 'accept' AND platform = 'instagram' THEN handle END, ' | ' ORDER BY CASE WHEN verdict = 'accept' AND platform = 'instagram' THEN handle END), '') AS instagram,
  coalesce(string_agg(DISTINCT CASE WHEN verdict = 'review' THEN platform || ':' || handle END, ' | ' ORDER BY CASE WHEN verdict = 'review' THEN platform || ':' || handle END), '') AS needs_review,
  round(count(DISTINCT CASE WHEN verdict = 'accept' THEN platform END) / 8.0::DOUBLE, 3) AS coverage FROM handle GROUP BY 1)
SELECT CAST(intake_id AS VARCHAR) AS row_id, name, CASE WHEN d.intake_id IS NULL THEN 'not_found' WHEN d.entity_id IS NULL THEN 'disambiguate' ELSE 'resolved' END AS decision, coalesce(d.entity_id, '') AS entity_id, coalesce(c.label, '') AS label,
  coalesce(array_to_string(c.roles, ', '), '') AS roles, coalesce(CAST(coverage AS VARCHAR), '') AS coverage, coalesce(needs_review, '') AS needs_review, coalesce(instagram, '') AS instagram
FROM i LEFT JOIN d USING (intake_id) LEFT JOIN c ON c.entity_id = d.entity_id LEFT JOIN q ON q.entity_id = d.entity_id""")
def result_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """The flat result sheet of all requests, of which the columns SQL is asked for are compared."""
    r = ranking.rank(_scored(spark, folder, False), "intake_id", "role_score", "entity_id").select("intake_id", "decision", F.when(F.col("decision") == "resolved", F.col("top")).alias("entity_id"))
    h = table(spark, folder, "handle")
    c = _candidates(spark, folder).select("entity_id", "label", F.array_join("roles", ", ").alias("roles"))
    j = _intakes(spark, folder).select("intake_id", "name").join(r, "intake_id", "left").join(c, "entity_id", "left").join(export.pivot_accounts(h, "entity_id"), "entity_id", "left").join(evidence.coverage(h, "entity_id"), "entity_id", "left")
    j = j.withColumn("row_id", F.col("intake_id")).withColumn("decision", F.coalesce("decision", F.lit("not_found")))
    return export.sheet(j).select(*_SHEET_COLUMNS)


# -- sheets and jobs ---------------------------------------------------------------------------------------------------

_ALIAS_SQL = "a(alias, field, place) AS (VALUES " + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(ingest._FIELD_OF.items())) + ")"
_NORM_SQL = r"trim(regexp_replace(regexp_replace(lower(coalesce(x, '')), '[_./\\-]', ' ', 'g'), '\s+', ' ', 'g'))"


def _sheets(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, row, cells: a title, the heading, a heading with less, and a record, of every file."""
    f = table(spark, folder, "parse_result").dropDuplicates(["file_id"]).filter("header IS NOT NULL")
    rows = F.array(F.array(F.lit("Talent list for Q3")), F.col("header"), F.slice("header", 1, 2), F.array(F.lit("1"), F.lit("A B")))
    return f.select("file_id", F.posexplode(rows).alias("row", "cells")).withColumn("row", F.col("row") + 1)


@query(rf"""WITH {_ALIAS_SQL}, f AS (SELECT DISTINCT ON (file_id) file_id, header FROM parse_result WHERE header IS NOT NULL),
h AS (SELECT file_id, x, {_NORM_SQL} AS n FROM (SELECT file_id, unnest(header) AS x FROM f)), s AS (SELECT file_id, bool_or(field = 'name') AS named FROM h LEFT JOIN a ON n = alias GROUP BY 1)
SELECT file_id, CASE WHEN named THEN 2 ELSE 1 END AS "row" FROM s""")
def header_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Which row of a sheet is its heading; a title that speaks of talents is not."""
    return ingest.header_rows(_sheets(spark, folder), "file_id", "row", "cells")


@query(rf"""WITH RECURSIVE {_ALIAS_SQL}, f AS (SELECT DISTINCT ON (file_id) file_id, header FROM parse_result WHERE header IS NOT NULL),
h AS (SELECT file_id, i, {_NORM_SQL} AS n FROM (SELECT file_id, unnest(range(1, len(header) + 1)) AS i, unnest(header) AS x FROM f)),
m AS (SELECT file_id, i, n, n IN ('title', 'type', 'category') AS several, coalesce((SELECT field FROM a WHERE alias = n), CASE WHEN length(n) <= 60 THEN (SELECT field FROM a WHERE length(alias) > 3 AND contains(n, alias) ORDER BY length(alias) DESC, place LIMIT 1) END) AS field FROM h),
s AS (SELECT file_id, i, n, several, CASE WHEN NOT several AND i = min(i) FILTER (NOT several) OVER (PARTITION BY file_id, field) THEN field END AS field FROM m),
c AS (SELECT file_id, coalesce(list(field) FILTER (field IS NOT NULL), []) AS claimed FROM s GROUP BY 1),
w AS (SELECT file_id, 0 AS i, claimed, []::VARCHAR[] AS fields FROM c UNION ALL
  SELECT file_id, s.i, CASE WHEN took IS NULL THEN claimed ELSE list_append(claimed, took) END, list_append(fields, coalesce(took, '')) FROM (SELECT w.*, s.i AS ni, coalesce(s.field, CASE WHEN several THEN list_filter(CASE WHEN n = 'title' THEN ['name', 'role'] ELSE ['role'] END, lambda x: NOT list_contains(claimed, x))[1] END) AS took FROM w JOIN s ON s.file_id = w.file_id AND s.i = w.i + 1) q JOIN s USING (file_id) WHERE s.i = q.ni)
SELECT w.file_id, array_to_string(fields, '|') AS fields FROM w JOIN f ON f.file_id = w.file_id AND w.i = len(header)""")
def mapped_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The field of every heading, by what else is in the sheet."""
    f = table(spark, folder, "parse_result").dropDuplicates(["file_id"]).filter("header IS NOT NULL")
    return f.select("file_id", F.array_join(F.transform(ingest.map_headers(F.col("header")), lambda x: F.coalesce(x, F.lit(""))), "|").alias("fields"))


_QUOTE_SQL = r"""CASE WHEN NOT contains({x}, '''') OR contains({x}, '"') THEN '''' || replace(replace(replace({x}, '\', '\\'), chr(10), '\n'), '''', '\''') || '''' ELSE '"' || replace(replace({x}, '\', '\\'), chr(10), '\n') || '"' END"""


@query(rf"""WITH k(word, bucket) AS (VALUES {_values(ingest._ROLE_OF)}), t AS (SELECT DISTINCT sheet_id, trim(coalesce(role, ''), ' ') AS r, trim(coalesce(active_year, ''), ' ') AS y, name FROM talent_finder_template),
w AS (SELECT sheet_id, [CASE WHEN trim(regexp_replace(lower(r), '\s+', ' ', 'g'), ' ') <> '' AND bucket IS NULL THEN 'unrecognised role ' || {_QUOTE_SQL.format(x='r')} || ' - treated as unknown' END,
  CASE WHEN y <> '' AND NOT (regexp_full_match(trim(split_part(y, '.', 1), ' '), '[0-9]+') AND coalesce(TRY_CAST(trim(split_part(y, '.', 1), ' ') AS INT), 0) BETWEEN 1800 AND 2100) THEN 'ignored active_year ' || {_QUOTE_SQL.format(x='y')} END,
  CASE WHEN trim(coalesce(name, ''), ' ') = '' THEN 'empty name - skipped' END] AS w FROM t LEFT JOIN k ON word = trim(regexp_replace(lower(r), '\s+', ' ', 'g'), ' '))
SELECT sheet_id, array_to_string(list_filter(w, lambda x: x IS NOT NULL), '; ') AS warnings FROM w WHERE len(list_filter(w, lambda x: x IS NOT NULL)) > 0""")
def row_warnings(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "talent_finder_template").select("sheet_id", "role", "active_year", "name").distinct()
    return t.select("sheet_id", F.array_join(ingest.row_warnings(F.col("role"), F.col("active_year"), F.col("name")), "; ").alias("warnings")).filter("warnings <> ''")


@query("SELECT DISTINCT line_id, raw_line AS text FROM upload_line WHERE raw_line IS NOT NULL")
def decoded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as bytes in one of three encodings, and back."""
    r = F.col("raw_line")
    latin = (F.col("line_id") % 3 == 0) & r.rlike(r"(?s)^[\x00-\x{FF}]*$")
    raw = F.when(latin, F.encode(r, "ISO-8859-1")).when(F.col("line_id") % 3 == 1, F.encode(F.concat(F.lit("﻿"), r), "UTF-8")).otherwise(F.encode(r, "UTF-8"))
    return table(spark, folder, "upload_line").filter("raw_line IS NOT NULL").select("line_id", sheets.decoded(raw).alias("text")).distinct()


@query("SELECT DISTINCT file_id, CASE file_id % 4 WHEN 0 THEN 'workbook' WHEN 1 THEN 'text' WHEN 2 THEN 'workbook' ELSE 'text' END AS format FROM parse_result")
def upload_formats(spark: SparkSession, folder: str) -> DataFrame:
    """By the name's ending, or by the first bytes of a name without one."""
    k = F.col("file_id") % 4
    name = F.when(k == 0, F.concat("filename", F.lit(".XLSX"))).when(k == 1, F.col("filename")).otherwise(F.lit("upload"))
    head = F.when(k == 2, F.lit(b"PK\x03\x04")).otherwise(F.lit(b"id,name"))
    return table(spark, folder, "parse_result").select("file_id", sheets.upload_format(name, head).alias("format")).distinct()


_JOBS_SQL = """f AS (SELECT DISTINCT ON (file_id) file_id, filename, received_at, errors IS NOT NULL AND len(errors) > 0 AS bad FROM parse_result),
t AS (SELECT file_id, count(DISTINCT parsed_id) AS total, count(DISTINCT CASE WHEN trim(coalesce(name, '')) <> '' THEN row_number END) AS n, max(CASE WHEN trim(coalesce(name, '')) <> '' THEN row_number END) AS last FROM parsed_row GROUP BY 1),
j AS (SELECT CAST(file_id AS VARCHAR) AS job_id, CASE WHEN last IS NULL THEN 'queued' WHEN file_id % 5 = 0 THEN 'failed' ELSE 'done' END AS state, filename, coalesce(total, 0) AS total, coalesce(last + 1, 0) AS processed,
  CASE WHEN coalesce(total, 0) > 0 THEN round(100.0::DOUBLE * coalesce(last + 1, 0) / total, 1) ELSE 0.0::DOUBLE END AS percent, received_at AS started_at, CASE WHEN last IS NOT NULL THEN received_at + INTERVAL 1 HOUR END AS finished_at FROM f LEFT JOIN t USING (file_id))"""


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    """A job for each file: created when it came, running, then done or failed once it has rows with a name."""
    files = table(spark, folder, "parse_result").dropDuplicates(["file_id"]).withColumn("job_id", F.col("file_id").cast("string"))
    rows = table(spark, folder, "parsed_row").dropDuplicates(["parsed_id"]).withColumn("job_id", F.col("file_id").cast("string"))
    total = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    events = rows.filter(F.trim(F.coalesce("name", F.lit(""))) != "").select("job_id", F.col("row_number").alias("seq"), F.col("name").alias("payload"), F.col("parsed_id").alias("at"))
    some = files.join(events.select("job_id").distinct(), "job_id", "left_semi")
    hour = lambda n: F.col("received_at") + F.expr(f"INTERVAL {n} MINUTES")
    state = lambda s, n: some.select("job_id", s.alias("state"), F.lit(None).cast("string").alias("error"), hour(n).alias("at"))
    states = state(F.lit("queued"), 0).unionByName(state(F.lit("running"), 30)).unionByName(state(F.when(F.col("file_id") % 5 == 0, "failed").otherwise("done"), 60))
    created = files.join(total, "job_id", "left").select("job_id", "filename", "total", F.col("received_at").alias("started_at"))
    return jobs.status(created, states, events).drop("error")


@query(f"WITH {_JOBS_SQL} SELECT * FROM j")
def job_status(spark: SparkSession, folder: str) -> DataFrame:
    return _jobs(spark, folder)


@query(f"WITH {_JOBS_SQL} SELECT job_id, started_at FROM j ORDER BY started_at DESC NULLS LAST, job_id LIMIT 20")
def recent_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.recent(_jobs(spark, folder)).select("job_id", "started_at")


@query("""SELECT file_id, row_number, name FROM (SELECT *, row_number() OVER (PARTITION BY file_id, row_number ORDER BY parsed_id DESC) AS k FROM parsed_row) WHERE k = 1""")
def job_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The latest payload of every row."""
    e = table(spark, folder, "parsed_row").select(F.col("file_id").alias("job_id"), F.col("row_number").alias("seq"), F.col("name").alias("payload"), F.col("parsed_id").alias("at"))
    return jobs.job_rows(e).select(F.col("job_id").alias("file_id"), F.col("seq").alias("row_number"), F.col("payload").alias("name"))


@query("""SELECT d.doc_id, c.status FROM (SELECT DISTINCT doc_id, coalesce(url, '') AS url FROM documents) d LEFT JOIN (SELECT DISTINCT ON (url_hash) url_hash, status FROM http_cache ORDER BY url_hash, fetched_at DESC) c ON c.url_hash = sha256(d.url)
UNION ALL SELECT -row_number() OVER (ORDER BY url), status FROM (SELECT url, arg_max(status, fetched_at) AS status FROM http_cache GROUP BY 1)""")
def cached_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """What the cache answers for the documents' addresses, and for its own."""
    from pyspark.sql import Window

    own = table(spark, folder, "http_cache")
    rehashed = store.latest(own.select("url", "status", "fetched_at").withColumn("url_hash", F.sha2("url", 256)), ["url_hash"], ["fetched_at"])
    asked = table(spark, folder, "documents").select("doc_id", F.coalesce("url", F.lit("")).alias("url")).distinct()
    told = cache.fetch(asked, store.latest(own.select("url_hash", "url", "status", "fetched_at"), ["url_hash"], ["fetched_at"])).select("doc_id", "status")
    urls_ = own.select("url").distinct().withColumn("doc_id", -F.row_number().over(Window.orderBy("url")).cast("bigint"))
    return told.unionByName(cache.fetch(urls_, rehashed).select("doc_id", "status"))


@query("SELECT authority, property FROM (VALUES " + ", ".join(f"('{a[0]}', '{a[2]}')" for a in authorities.AUTHORITIES if a[2] and not a[6]) + ") t(authority, property)")
def property_audit(spark: SparkSession, folder: str) -> DataFrame:
    return authorities.unverified(spark)


_PROPERTY_ROWS = ", ".join(f"('{p}')" for p in sorted({a[2] for a in authorities.AUTHORITIES if a[2]}))


@query(f"SELECT p AS property, CASE CAST(substr(p, 2) AS INT) % 4 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'label of ' || p WHEN 2 THEN '?' ELSE 'ERROR: timeout' END AS result FROM (VALUES {_PROPERTY_ROWS}) t(p)")
def property_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of properties as a graph gave them: none, an English one, one in another language only, or an error."""
    p = authorities.authorities(spark).filter("property IS NOT NULL").select("property").distinct()
    k = F.substring("property", 2, 9).cast("int") % 4
    labels = p.filter(k > 0).select("property", F.when(k == 1, "en").when(k == 2, "de").alias("lang"), F.when(k < 3, F.concat(F.lit("label of "), "property")).alias("label"), F.when(k == 3, "timeout").alias("error"))
    return authorities.validated(spark, labels)


@query("SELECT DISTINCT intake_id, CASE expected_role " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in authorities.ANCHORS.items()) + f" ELSE '{','.join(authorities.ANCHORS_OF_OTHERS)}' END AS anchors FROM intake")
def role_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "intake").select("intake_id", F.array_join(authorities.anchors(F.col("expected_role")), ",").alias("anchors")).distinct()


@query("""WITH r AS (SELECT DISTINCT ON (file_id, row_number) file_id, row_number AS rn, name, warnings FROM parsed_row ORDER BY file_id, row_number, parsed_id),
w AS (SELECT file_id, rn, generate_subscripts(warnings, 1) AS p, unnest(warnings) AS w FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rn, p) AS k FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rn) AS k FROM r WHERE trim(coalesce(name, '')) <> '')
SELECT file_id, a.warnings, b.preview FROM (SELECT file_id, string_agg('row ' || rn || ': ' || w, '; ' ORDER BY k) AS warnings FROM k WHERE k <= 50 GROUP BY 1) a FULL JOIN (SELECT file_id, string_agg(name, '; ' ORDER BY k) AS preview FROM n WHERE k <= 10 GROUP BY 1) b USING (file_id)""")
def validation_preview(spark: SparkSession, folder: str) -> DataFrame:
    r = ranking.first_of(table(spark, folder, "parsed_row").select("file_id", "row_number", "parsed_id", "name", "warnings"), ["file_id", "row_number"], ["parsed_id"])
    return ingest.validation_preview(r, "file_id", "row_number")


@query("""SELECT entity_id, platform, string_agg(handle, ' | ' ORDER BY o, handle) AS handles FROM (SELECT entity_id, platform, handle, min(handle_id) AS o FROM handle WHERE verdict = 'accept' GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def accepted_in_order(spark: SparkSession, folder: str) -> DataFrame:
    return export.accepted(table(spark, folder, "handle"), "entity_id", "handle_id")


#: Answers in place of live ones: the first whose part the address holds counts.
FIXTURES = [("press", "a press note"), (".example/1", "a page"), ("//", "any page")]


@query("SELECT DISTINCT doc_id, CASE " + " ".join(f"WHEN contains(url, '{n}') THEN '{b}'" for n, b in FIXTURES) + " END AS body FROM documents")
def fixture_answers(spark: SparkSession, folder: str) -> DataFrame:
    return cache.fixture(table(spark, folder, "documents").select("doc_id", "url"), FIXTURES).select("doc_id", "body").distinct()


@query("""SELECT DISTINCT entity_id, notable_work[1] AS title, CAST(birth_year AS VARCHAR) AS year FROM candidate WHERE len(notable_work) > 0 AND birth_year % 2 = 0""")
def title_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A person's first work out of a title record, where one was found."""
    c = table(spark, folder, "candidate").filter("size(notable_work) > 0")
    found = F.when(F.col("birth_year") % 2 == 0, "True").otherwise("False")
    body = F.to_json(F.struct(found.alias("Response"), F.element_at("notable_work", 1).alias("Title"), F.col("birth_year").cast("string").alias("Year")))
    return c.select("entity_id", discovery.title_of(body).alias("t")).filter("t IS NOT NULL").select("entity_id", "t.title", "t.year").distinct()
