"""Steps of a resolution on small fixtures."""

import pytest
from pyspark.sql import functions as F

from rosterlens.functions import extract, urls
from rosterlens.operators import authorities, claims, discovery, evidence, export, ingest, jobs, ranking
from rosterlens.sources import sheets


def test_links_of_pages_whatever_their_quotes_and_scripts(spark):
    pages = [
        """<A class=x HREF=https://x.com/ab>1</A><a href = 'https://tiktok.com/@ab'>2</a><p>href="https://imdb.com/name/nm1"</p><a href="/own">3</a>""",
        """<script>window.__NUXT__ = {u:"https://instagram.com/ab"};</script><script id=__NEXT_DATA__ type='application/json'>{"href":"see https://x.com/a.","k":["http://b.org/c?d=1#e","x"]}</script>""",
        """<script type="application/ld+json">{"@id":"https://x.com/ab","name":"n https://no.org"}</script><script id="__NEXT_DATA__">{"u":"https://cut</script>""",
        "", None,
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    got = [r[0] for r in df.sort("i").select(extract.extract_links(F.col("h"))).collect()]
    assert got == [["https://x.com/ab", "https://tiktok.com/@ab"], ["https://x.com/a", "http://b.org/c?d=1#e", "https://instagram.com/ab"], ["https://x.com/ab"], [], []]
    assert [[x.platform for x in r[0]] for r in df.sort("i").select(extract.harvest(F.col("h"))).collect()] == [["twitter", "tiktok"], ["twitter", "instagram"], ["twitter"], [], []]


def test_json_strings_are_values_not_keys(spark):
    texts = ['{"a":"b","c":["d","e\\"f",{"g":"h:"}],"i":1,"":"\\u00e9\\n"}', '"x"', "[]", '{"a":"b"', None, '{"k" : "v" , "w":""}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.sort("i").select(extract.json_strings(F.col("t"))).collect()] == [["b", "d", 'e"f', "h:", "\u00e9\n"], ["x"], [], [], [], ["v", ""]]


ITEM = """{"claims":{"P345":[{"mainsnak":{"datavalue":{"value":"nm0000001"}}},{"mainsnak":{"datavalue":{"value":"nm0000002"}}},{"mainsnak":{}}],"P2397":[{"mainsnak":{"datavalue":{"value":"UCx"}}}],
"P8286":[{"mainsnak":{"datavalue":{"value":"7"}}}],"P31":[{"mainsnak":{"datavalue":{"value":{"id":"Q5"}}}}]},"sitelinks":{"enwiki":{"title":"A B"},"zh_yuewiki":{"title":"C"},"commonswiki":{"title":"D"},"enwikiquote":{"title":"E"},"dewiki":{"title":""}}}"""


def test_claims_of_an_item(spark):
    items = spark.createDataFrame([("k", ITEM), ("l", None), ("m", "{}")], "k string, item string")
    assert {(r.authority, r.id) for r in claims.external_ids(items, "k", "item").collect()} == {("imdb", "nm0000002"), ("youtube_channel", "UCx"), ("olympedia", "7")}
    got = {(r.platform, r.handle, r.id_kind, r.lang, r.authoritative) for r in claims.item_claims(items, "k", "item").collect()}
    assert got == {("imdb", "nm0000001", "handle", "", True), ("imdb", "nm0000002", "handle", "", True), ("youtube", "UCx", "channel_id", "", False), ("wikipedia", "A B", "page_title", "en", True), ("wikipedia", "C", "page_title", "zh-yue", True)}


def test_claims_of_records_relations_and_pages(spark):
    r = spark.createDataFrame([("a", True, "nm1", " @@x ", None, "", "y", None), ("b", False, "nm2", None, None, None, None, None)], "k string, g boolean, imdb_id string, instagram_id string, twitter_id string, tiktok_id string, youtube_id string, facebook_id string")
    assert {(x.k, x.platform, x.handle, x.tier, x.authoritative) for x in claims.record_claims(r, "k", "g").collect()} == {("a", "imdb", "nm1", 1, True), ("a", "instagram", "x", 1, False), ("a", "youtube", "y", 1, False), ("b", "imdb", "nm2", 4, False)}
    rel = spark.createDataFrame([("a", "https://x.com/q", "social network"), ("a", "https://no.org", "x"), ("a", None, None), ("a", "https://tiktok.com/@q", None)], "k string, u string, t string")
    assert {(x.platform, x.source) for x in claims.relation_claims(rel, "k", "u", "t").collect()} == {("twitter", "musicbrainz:social network"), ("tiktok", "musicbrainz:url")}
    seeds = spark.createDataFrame([("a", "".join(f"<a href='https://linktr.ee/{i}'>" for i in (1, 2, 1, 3, 4, 5)) + "<a href='https://x.com/own'>"), ("b", None)], "k string, h string")
    pages = spark.createDataFrame([(f"https://linktr.ee/{i}", f"<a href='https://x.com/p{i}'>") for i in range(1, 6)], "url string, body string")
    assert {x.handle for x in claims.cascade(seeds, "k", "h", pages).collect()} == {"p1", "p2", "p3", "p4"}
    acc = spark.createDataFrame([("a", "twitter:p", "twitter", "u1"), ("a", "tiktok:q", "tiktok", "u2"), ("b", "tiktok:q", "tiktok", "u3")], "k string, ref_key string, platform string, url string")
    body = spark.createDataFrame([("u1", "<a href='https://x.com/p'><a href='https://tiktok.com/@Q'><a href='https://x.com/z'>"), ("u3", "<a href='https://x.com/p'>")], "url string, body string")
    assert {(x.k, x.platform, x.source) for x in claims.back_link_claims(acc, "k", body).collect()} == {("a", "tiktok", "backlink_from:twitter")}
    ld = spark.createDataFrame([("a", """<script type="application/ld+json">{"x":{"sameAs":["https://x.com/s",5]},"sameAs":"https://tiktok.com/@s"}</script>"""), ("b", "<p>")], "k string, h string")
    assert {x.platform for x in claims.same_as_claims(ld, "k", "h").collect()} == {"twitter", "tiktok"}


def test_three_namesakes_end_to_end(spark):
    """One request, its accounts from several sources: coverage 0.625, the rest in review."""
    rows = [("instagram", 1, False), ("instagram", 2, False), ("twitter", 1, False), ("twitter", 3, False), ("tiktok", 3, False), ("imdb", 1, True), ("wikipedia", 1, True), ("facebook", 2, False), ("youtube", 1, False), ("linkedin", 5, False)]
    e = spark.createDataFrame([("Q1", p, p, "", t, a) for p, t, a in rows], "e string, platform string, handle string, lang string, tier int, authoritative boolean")
    v = evidence.claim_confidence(e, ["e", "platform"])
    assert {r.platform: r.verdict for r in v.collect()} == {"instagram": "accept", "twitter": "accept", "tiktok": "accept", "imdb": "accept", "wikipedia": "accept", "facebook": "review", "youtube": "review", "linkedin": "reject"}
    assert evidence.coverage(v, "e").first().coverage == 0.625


def test_people_found_by_name(spark):
    df = spark.createDataFrame([(1, "a", 90.0, "Sound", "Ann"), (1, "b", 5.0, "Acting", "Ann"), (2, "c", 1.0, "Crew", "Bo"), (3, "d", 10.0, "Acting", "X"), (3, "e", 9.0, "Acting", "X")], "q int, p string, pop double, dept string, name string")
    s = df.withColumn("s", ranking.person_score(F.col("pop"), F.col("dept"), F.lit("musician"), F.col("name"), F.lit("ann ")))
    assert {r.p: r.s for r in s.collect()} == {"a": 2.3, "b": -0.1, "c": -0.48, "d": -0.3, "e": -0.32}
    assert {r.q: (r.person, r.decision) for r in ranking.rank_people(s, "q", "s", "p").collect()} == {1: ("a", "resolved"), 2: ("c", "resolved"), 3: (None, "ambiguous")}


def test_answers_of_catalogues(spark):
    b = spark.range(1)
    one = lambda c: b.select(c).first()[0]
    assert one(discovery.artist_ids(F.lit('{"artists":[{"id":"a","score":100},{"id":"b","score":"90"},{"id":"c","score":84},{"id":"","score":99},{"id":"d","score":"x"},{"id":"e"}]}'))) == ["a", "b"]
    assert one(discovery.author_keys(F.lit('{"docs":[{"key":"a"},{},{"key":"b"},{"key":"c"},{"key":"d"}]}'))) == ["a", "b", "c"]
    assert one(discovery.cluster_ids(F.lit('{"result":[{"viafid":"1"},{},{"viafid":"2"},{"viafid":"3"}]}'))) == ["1", "2"]
    assert one(discovery.article_titles(F.lit('{"query":{"search":[{"title":"A B"},{"title":""},{"title":"C/D"}]}}'), F.lit("en"))) == ["https://en.wikipedia.org/wiki/A_B", "https://en.wikipedia.org/wiki/C/D"]
    assert one(F.size(discovery.organic(F.lit('{"organic_results":"no list"}')))) == 0 and one(F.size(discovery.organic(F.lit(None).cast("string")))) == 0
    assert one(discovery.title_of(F.lit('{"Response":"True","Title":"T","Year":"1999"}'))).title == "T" and one(discovery.title_of(F.lit('{"Response":"False"}'))) is None
    assert one(discovery.platform_order(F.lit("executive"))) == ["linkedin", "twitter"] and len(one(discovery.platform_order(F.lit(None).cast("string")))) == 6


def test_a_staged_search_stops_where_it_finds(spark):
    rows = [
        (1, 1, None, 1, "https://linktr.ee/a", "Ann Lee links"), (1, 3, "instagram", 1, "https://instagram.com/a", "x"), (2, 2, None, 1, "https://no.org", "x"), (2, 2, None, 2, "https://en.wikipedia.org/wiki/Ann", "ANN-LEE"),
        (2, 3, "twitter", 1, "https://x.com/a", "x"), (3, 3, "twitter", 1, "https://instagram.com/b", "x"), (3, 3, "twitter", 2, "https://x.com/b", "x"), (3, 3, "instagram", 2, "https://instagram.com/B", "x"),
        (3, 3, "instagram", 1, "https://instagram.com/b/", "x"), (3, 3, "imdb", 1, "https://imdb.com/name/nm0000001", "x"), (4, 1, None, 1, "", None),
    ]
    df = spark.createDataFrame(rows, "q int, stage int, asked string, rank int, link string, title string")
    got = discovery.staged(df, "q", F.lit("Ann Lee"), F.lit("journalist"))
    assert sorted((r.q, r.stage, r.platform, r.handle, r.name_in_title) for r in got.collect()) == [(1, 1, None, None, True), (2, 2, "wikipedia", "Ann", True), (3, 3, "instagram", "b", False), (3, 3, "twitter", "b", False)]


def test_sheets_in_several_encodings_and_formats(spark, tmp_path):
    for name, raw in {"a.csv": "﻿id;name\n1;J\u00f6rg\n".encode(), "b.TXT": "id;name\n1;J\u00f6rg\n".encode("latin-1"), "c": b"PK\x03\x04", "d.xlsx": b"x", "e": "id;name\n1;J\u00f6rg\n".encode()}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.text, r.error) for r in sheets.read_uploads(spark, str(tmp_path)).collect()}
    text = "id;name\n1;J\u00f6rg\n"
    assert got == {"a.csv": ("text", text, None), "b.TXT": ("text", text, None), "e": ("text", text, None), "c": ("workbook", None, "workbooks cannot be read"), "d.xlsx": ("workbook", None, "workbooks cannot be read")}
    assert [r.name for f in ("a.csv", "b.TXT") for r in sheets.read_sheet(spark, str(tmp_path / f)).collect()] == ["J\u00f6rg"] * 2


def test_the_result_sheet_has_its_columns_and_mark(spark, tmp_path):
    df = export.sheet(spark.createDataFrame([("r1", "n", 0.5, "extra")], "row_id string, name string, coverage double, other string"))
    assert df.columns == ["row_id", "name", "decision", "entity_id", "label", "roles", "coverage", "label_match", *urls.PLATFORMS, "needs_review", "spoke_ids", "alternates", "notes"]
    export.write_csv(df, str(tmp_path / "out"), mark=True)
    raws = [f.read_bytes() for f in (tmp_path / "out").glob("*.csv")]
    assert all(r.startswith(b"\xef\xbb\xbfrow_id,name,decision") for r in raws) and sum(b"r1,n" in r for r in raws) == 1


@pytest.mark.parametrize(("header", "fields"), [(["Talent Name", "Title"], ["name", "role"]), (["TITLE"], ["name"]), (["Title", "Name", "Type"], ["role", "name", None]), (["Follower Count 2024", "name", "Full Name"], [None, "name", None]), (["Category", "Talent Name (English)"], ["role", "name"]), ([], [])])
def test_headings_by_what_else_is_there(spark, header, fields):
    assert spark.createDataFrame([(header,)], "h array<string>").select(ingest.map_headers(F.col("h"))).first()[0] == fields


def test_header_rows_and_warnings(spark):
    rows = [(1, 1, ["Talent list for Q3"]), (1, 2, ["Name", "Role"]), (1, 3, ["name", "role", "year"]), (1, 4, ["name", "role", "market"]), (2, 1, ["x"]), (2, 2, ["Names of talents"]), (3, 16, ["name"])]
    df = spark.createDataFrame(rows, "s int, r int, c array<string>")
    assert {r.s: r.r for r in ingest.header_rows(df, "s", "r", "c").collect()} == {1: 3, 2: 2}
    w = spark.createDataFrame([("astronaut", "soon", " "), ("it's", "1999.0", "A"), (None, None, "A")], "r string, y string, n string").select(ingest.row_warnings(F.col("r"), F.col("y"), F.col("n"))).collect()
    assert [r[0] for r in w] == [["unrecognised role 'astronaut' - treated as unknown", "ignored active_year 'soon'", "empty name - skipped"], ["unrecognised role \"it's\" - treated as unknown"], []]


def test_jobs(spark, tmp_path):
    made = spark.createDataFrame([("a", "f", 4, 10), ("b", "g", 0, 20), ("c", "h", 3, 30)], "job_id string, filename string, total int, started_at int")
    states = spark.createDataFrame([("a", "running", None, 11), ("a", "done", None, 19), ("b", "failed", "no name", 21)], "job_id string, state string, error string, at int")
    rows = spark.createDataFrame([("a", 0, "x", 12), ("a", 2, "y", 13), ("a", 0, "z", 14)], "job_id string, seq int, payload string, at int")
    got = {r.job_id: (r.state, r.processed, r.percent, r.finished_at, r.error) for r in jobs.status(made, states, rows).collect()}
    assert got == {"a": ("done", 3, 75.0, 19, None), "b": ("failed", 0, 0.0, 21, "no name"), "c": ("queued", 0, 0.0, None, None)}
    assert [(r.seq, r.payload) for r in jobs.job_output(rows, "a").collect()] == [(0, "z"), (2, "y")]
    assert [r.job_id for r in jobs.recent(jobs.status(made, states, rows), 2).collect()] == ["c", "b"]
    for _ in range(2):
        jobs.append(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_tables_without_rows(spark):
    items = spark.createDataFrame([], "k string, item string")
    assert claims.item_claims(items, "k", "item").count() == 0 and claims.external_ids(items, "k", "item").count() == 0
    assert ranking.rank(spark.createDataFrame([], "q int, s double, o string"), "q", "s", "o").count() == 0
    assert authorities.by_property(spark).filter("property = 'P8286'").first().authority == "olympedia"
