"""What searches return: answers of free catalogues, and staged search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, urls
from .ranking import top_k

# The platforms to search, in their order, for each role.
PRIORITY = {
    "musician": ["instagram", "twitter", "tiktok", "youtube", "facebook"], "creator": ["instagram", "tiktok", "youtube", "twitter"],
    "actor": ["instagram", "imdb", "twitter", "facebook"], "director": ["imdb", "instagram", "twitter"], "athlete": ["instagram", "twitter", "facebook"],
    "executive": ["linkedin", "twitter"], "journalist": ["twitter", "linkedin", "instagram"],
}
PRIORITY_OF_OTHERS = ["instagram", "twitter", "facebook", "tiktok", "youtube", "imdb"]
SEARCHES, PROPOSALS, TITLE, SNIPPET = 6, 12, 120, 200
ARTIST_SCORE = 85


def _json(body: Column, schema: str) -> Column:
    return F.from_json(body, schema)


def article_titles(body: Column, lang: Column, most: int = 5) -> Column:
    """URLs of the articles a full-text search found, in order."""
    hits = F.slice(F.filter(_json(body, "query struct<search:array<struct<title:string>>>")["query"]["search"], lambda h: F.coalesce(h["title"], F.lit("")) != ""), 1, most)
    page = lambda t: F.replace(F.url_encode(F.replace(t, F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/"))
    return F.transform(hits, lambda h: F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), page(h["title"])))


def first_answering(answers: DataFrame, key: str, place: str, links: str) -> DataFrame:
    """Of each key the links of the first edition in ``place`` that has any: key, ``link``, ``rank``."""
    some = answers.filter(F.size(links) > 0)
    first = some.groupBy(key).agg(F.min_by(links, place).alias("l"))
    return first.select(key, F.posexplode(F.array_distinct("l")).alias("rank", "link"))


def artist_ids(body: Column, least: int = ARTIST_SCORE) -> Column:
    """Ids of the artists a catalogue is sure of, in order."""
    found = _json(body, "artists array<struct<id:string,score:string>>")["artists"]
    return F.transform(F.filter(found, lambda a: (F.coalesce(a["score"].try_cast("int"), F.lit(0)) >= least) & (F.coalesce(a["id"], F.lit("")) != "")), lambda a: a["id"])


def player_links(body: Column, most: int = 2) -> Column:
    """Accounts of the first players an answer names: five columns of links, turned into rows, each account once."""
    fields = ["strInstagram", "strTwitter", "strFacebook", "strYoutube", "strWebsite"]
    players = F.slice(_json(body, "player array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")["player"], 1, most)
    links = F.flatten(F.transform(players, lambda p: F.filter(F.array(*[p[f] for f in fields]), lambda u: F.coalesce(u, F.lit("")) != "")))
    refs = F.filter(F.transform(links, lambda u: urls.classify_url(F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u)))), lambda r: r.isNotNull())
    keys = F.transform(refs, lambda r: urls.ref_key(r["platform"], r["handle"], r["lang"]))
    return F.filter(refs, lambda r, i: F.array_position(keys, urls.ref_key(r["platform"], r["handle"], r["lang"])) == i + 1)


def author_keys(body: Column, most: int = 3) -> Column:
    """The first keys among authors that have one."""
    docs = _json(body, "docs array<struct<key:string>>")["docs"]
    return F.slice(F.filter(F.transform(docs, lambda d: d["key"]), lambda k: F.coalesce(k, F.lit("")) != ""), 1, most)


def cluster_ids(body: Column, most: int = 3) -> Column:
    """The ids that the first authority clusters have."""
    found = _json(body, "result array<struct<viafid:string>>")["result"]
    return F.filter(F.transform(F.slice(found, 1, most), lambda r: r["viafid"]), lambda v: F.coalesce(v, F.lit("")) != "")


def organic(body: Column) -> Column:
    """The organic results of a search answer; none if they are no list."""
    return F.coalesce(_json(body, "organic_results array<struct<link:string,title:string,snippet:string>>")["organic_results"], F.array().cast("array<struct<link:string,title:string,snippet:string>>"))


def title_of(body: Column) -> Column:
    """struct(title, year, type, imdb_id) of a title record that was found, else null."""
    r = _json(body, "Response string, Title string, Year string, Type string, imdbID string")
    return F.when(r["Response"] == "True", F.struct(r["Title"].alias("title"), r["Year"].alias("year"), r["Type"].alias("type"), r["imdbID"].alias("imdb_id")))


def platform_order(role: Column) -> Column:
    """The platforms to search for a role, first to last."""
    table = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, F.coalesce(role, F.lit(""))), F.array(*map(F.lit, PRIORITY_OF_OTHERS)))


def staged(results: DataFrame, request: str, name: Column, role: Column, budget: int = SEARCHES) -> DataFrame:
    """Search results a staged search would have come to: request, ``stage``, ``link``, ``platform``, ``handle``, ``lang``, ``rank``, ``title``, ``name_in_title``.

    results: request, ``stage`` (1 link-in-bio pages, 2 articles, 3 a platform's pages), ``asked`` (stage 3: the platform), ``rank``,
    ``link``, ``title``, and what name and role need. A stage is left out where an earlier one found something: any link counts in stage 1,
    an article in stage 2, an account of the platform asked in stage 3, for which the budget less the two searches before
    is left. Of an account the first result counts.
    """
    ref = urls.classify_url(F.col("link"))
    r = results.filter(F.coalesce("link", F.lit("")) != "").withColumn("__ref", ref).withColumn("__turn", F.when(F.col("stage") == 3, F.array_position(platform_order(role), F.col("asked"))).otherwise(0))
    fits = F.when(F.col("stage") == 1, F.lit(True)).when(F.col("stage") == 2, F.col("__ref.platform") == "wikipedia").otherwise((F.col("__ref.platform") == F.col("asked")) & F.col("__turn").between(1, budget - 2))
    r = r.filter(F.coalesce(fits, F.lit(False)))
    r = r.withColumn("__key", F.when(F.col("stage") == 1, F.col("link")).otherwise(urls.ref_key(F.col("__ref.platform"), F.col("__ref.handle"), F.col("__ref.lang"))))
    first = r.groupBy(request).agg(F.min("stage").alias("__stage"))
    r = r.join(first, request).filter("stage = __stage")
    told = F.struct("stage", "link", "__ref.platform", "__ref.handle", "__ref.lang", "rank", F.substring("title", 1, TITLE).alias("title"), names.name_in_title(name, F.col("title")).alias("name_in_title"))
    return r.groupBy(request, "__key").agg(F.min_by(told, F.struct("__turn", "rank")).alias("t")).select(request, "t.*")


def by_platform(proposals: DataFrame, request: str, most: int = PROPOSALS) -> DataFrame:
    """request, ``platform``, ``handles`` (in rank order, joined): of each request the first proposals only."""
    first = top_k(proposals.filter("platform IS NOT NULL"), [request], [F.col("stage"), F.col("rank"), F.col("platform"), F.col("handle")], most, "__k")
    return first.groupBy(request, "platform").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "handle"))), lambda x: x["handle"]), " | ").alias("handles"))
