"""Claims: evidence that an account is a person's, out of items, records, relations and pages.

Every source gives the same columns, so that evidence is a union: entity, ``platform``, ``handle``, ``id_kind``, ``lang``,
``tier``, ``source``, ``authoritative``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract, urls
from .authorities import by_property
from .ranking import top_k

# Tiers of evidence, fields of an external-id record and their platforms, sites of an item that are no edition.
STRUCTURED, SELF_DECLARED, BIDIRECTIONAL, CORROBORATING = 1, 2, 3, 4
FIELDS = {"imdb_id": "imdb", "instagram_id": "instagram", "twitter_id": "twitter", "tiktok_id": "tiktok", "youtube_id": "youtube", "facebook_id": "facebook"}
NO_EDITION = ["commonswiki", "specieswiki"]
PAGES = 4

COLUMNS = ["platform", "handle", "id_kind", "lang", "tier", "source", "authoritative"]
_STATEMENTS = "array<struct<mainsnak:struct<datavalue:struct<value:string>>>>"


def statements(items: DataFrame, key: str, item: str) -> DataFrame:
    """key, ``property``, ``place``, ``value`` of every statement of an item (a JSON text) with a string for its value."""
    held = items.select(key, F.explode(F.try_variant_get(F.try_parse_json(item), "$.claims", "map<string,variant>")).alias("property", "__s"))
    each = held.select(key, "property", F.posexplode(F.try_variant_get("__s", "$", "array<variant>")).alias("place", "__v"))
    v = F.try_variant_get("__v", "$.mainsnak.datavalue.value", "variant")
    return each.filter(F.schema_of_variant(v) == "STRING").select(key, "property", "place", F.try_variant_get(v, "$", "string").alias("value"))


def external_ids(items: DataFrame, key: str, item: str) -> DataFrame:
    """key, ``authority``, ``id``: the last statement of each authority's property."""
    s = statements(items, key, item).join(F.broadcast(by_property(items.sparkSession).select("property", "authority")), "property")
    return s.groupBy(key, "authority").agg(F.max_by("value", "place").alias("id"))


def item_claims(items: DataFrame, key: str, item: str) -> DataFrame:
    """Claims of an item: accounts its statements name, and its articles."""
    a = by_property(items.sparkSession).filter("platform IS NOT NULL").select("property", "authority", "platform", "self_sufficient")
    stated = statements(items, key, item).join(F.broadcast(a), "property")
    kind = F.when(F.col("authority") == "youtube_channel", "channel_id").otherwise("handle")
    accounts = stated.select(key, "platform", F.col("value").alias("handle"), kind.alias("id_kind"), F.lit("").alias("lang"), F.lit(STRUCTURED).alias("tier"), F.concat(F.lit("wikidata:"), "property").alias("source"), F.col("self_sufficient").alias("authoritative"))
    links = items.select(key, F.explode(F.try_variant_get(F.try_parse_json(item), "$.sitelinks", "map<string,variant>")).alias("site", "__l"))
    links = links.select(key, "site", F.try_variant_get("__l", "$.title", "string").alias("title")).filter(F.col("site").endswith("wiki") & ~F.col("site").isin(NO_EDITION) & (F.coalesce("title", F.lit("")) != ""))
    lang = F.replace(F.regexp_replace("site", "wiki$", ""), F.lit("_"), F.lit("-"))
    articles = links.select(key, F.lit("wikipedia").alias("platform"), F.col("title").alias("handle"), F.lit("page_title").alias("id_kind"), lang.alias("lang"), F.lit(STRUCTURED).alias("tier"), F.concat(F.lit("wikidata:sitelink:"), "site").alias("source"), F.lit(True).alias("authoritative"))
    return accounts.unionByName(articles)


def record_claims(records: DataFrame, key: str, from_graph: str) -> DataFrame:
    """Claims of external-id records (columns FIELDS): structured if the record's id came from the graph, else corroborating."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p).alias("platform"), F.trim(F.col(f)).alias("value")) for f, p in FIELDS.items()])
    each = records.select(key, from_graph, F.explode(pairs).alias("x")).select(key, from_graph, "x.field", "x.platform", F.regexp_replace("x.value", "^@+", "").alias("handle")).filter("handle <> ''")
    tier = F.when(F.col(from_graph), STRUCTURED).otherwise(CORROBORATING)
    return each.select(key, "platform", "handle", F.lit("handle").alias("id_kind"), F.lit("").alias("lang"), tier.alias("tier"), F.concat(F.lit("tmdb:"), "field").alias("source"), (F.col(from_graph) & (F.col("platform") == "imdb")).alias("authoritative"))


def _refs(df: DataFrame, key: str, ref: str, tier: int, source) -> DataFrame:
    return df.filter(F.col(ref).isNotNull()).select(key, f"{ref}.platform", f"{ref}.handle", f"{ref}.id_kind", F.coalesce(F.col(f"{ref}.lang"), F.lit("")).alias("lang"), F.lit(tier).alias("tier"), source.alias("source"), F.lit(False).alias("authoritative"))


def relation_claims(relations: DataFrame, key: str, resource: str, kind: str) -> DataFrame:
    """Claims of an artist's relations: those that lead to an account."""
    j = relations.select(key, F.coalesce(kind, F.lit("url")).alias("__kind"), urls.classify_url(F.col(resource)).alias("__ref"))
    return _refs(j, key, "__ref", STRUCTURED, F.concat(F.lit("musicbrainz:"), "__kind"))


def same_as_claims(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Claims of a page's linked data: the accounts it says are its own."""
    each = pages.select(key, F.explode(extract.linked_data(F.col(html))).alias("__d")).select(key, F.explode(extract.same_as("__d")).alias("__u"))
    return _refs(each.select(key, urls.classify_url(F.col("__u")).alias("__ref")), key, "__ref", SELF_DECLARED, F.lit("schema.org:sameAs"))


def cascade(seeds: DataFrame, key: str, html: str, pages: DataFrame, most: int = PAGES) -> DataFrame:
    """Claims two steps from a seed page: its links to link-in-bio pages, of which the first ``most`` are read, and the accounts these name.

    seeds: key, html; pages: ``url``, ``body``, each URL once.
    """
    links = seeds.select(key, F.posexplode(extract.extract_links(F.col(html))).alias("__place", "url")).filter(urls.is_aggregator(F.col("url")))
    read = top_k(links, [key], [F.col("__place")], most, "__rank").select(key, "url")
    found = read.join(pages.select("url", "body"), "url").select(key, F.explode(extract.harvest(F.col("body"))).alias("__ref"))
    return _refs(found, key, "__ref", SELF_DECLARED, F.lit("aggregator"))


def back_link_claims(claims: DataFrame, key: str, pages: DataFrame) -> DataFrame:
    """Claims that an account's own page links to another account of the same entity.

    claims: key, ``ref_key``, ``platform``, ``url``; pages: ``url``, ``body``. Equi-joins only; an account's link to itself is none.
    """
    links = claims.join(pages.select("url", "body"), "url").select(key, F.col("platform").alias("__from"), F.col("ref_key").alias("__src"), F.explode(extract.harvest(F.col("body"))).alias("__ref"))
    links = links.withColumn("ref_key", urls.ref_key(F.col("__ref.platform"), F.col("__ref.handle"), F.col("__ref.lang"))).filter("ref_key <> __src")
    met = links.join(claims.select(key, "ref_key").distinct(), [key, "ref_key"], "left_semi")
    return _refs(met, key, "__ref", BIDIRECTIONAL, F.concat(F.lit("backlink_from:"), "__from"))


def union(claims: list[DataFrame], key: str) -> DataFrame:
    """All evidence as one table, with the account's ``ref_key``."""
    every = reduce(DataFrame.unionByName, [c.select(key, *COLUMNS) for c in claims])
    return every.withColumn("ref_key", urls.ref_key(F.col("platform"), F.col("handle"), F.col("lang")))


def lookup_handles(asked: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """asked (``platform``, ``handle``) with the ``entity_id`` of the first known row in ``order`` of that account, whatever its case."""
    first = known.groupBy("platform", F.lower("handle").alias("__h")).agg(F.min_by("entity_id", order).alias("entity_id"))
    j = asked.withColumn("__h", F.lower("handle"))
    return j.join(first, ["platform", "__h"], "left").drop("__h")


def lookup_collisions(asked: DataFrame, name: str, registry: DataFrame, label: str) -> DataFrame:
    """asked with the registry's ``n_candidates`` and ``roles`` for its name, whatever its case; null where none is known."""
    r = registry.groupBy(F.lower(label).alias("__n")).agg(F.max_by(F.struct("n_candidates", "roles"), F.struct("n_candidates", label)).alias("r")).select("__n", "r.*")
    return asked.withColumn("__n", F.lower(name)).join(r, "__n", "left").drop("__n")


def article_items(articles: DataFrame, key: str, url: str, place: str, items: DataFrame, most: int = 3) -> DataFrame:
    """key, ``item``, ``place``: the items whose sitelinks the first articles of a key are, each once, in the articles' order.

    items: ``site``, ``title``, ``item``. The articles' number is bounded before they are read.
    """
    first = top_k(articles.select(key, url, place), [key], [F.col(place)], most, "__rank").withColumn("__s", urls.wikipedia_site(F.col(url))).filter("__s IS NOT NULL")
    j = first.select(key, place, "__s.*").join(items, ["site", "title"]).filter(F.col("item").startswith("Q"))
    return j.groupBy(key, "item").agg(F.min(place).alias("place"))
