"""Goldens and properties of the engine's own operators."""

import pytest
from pyspark.sql import functions as F

from rosterlens.functions import extract, names, urls
from rosterlens.operators import evidence, ingest, ranking, store
from rosterlens.plans import resolve
from rosterlens.sources import cache, sheets
from rosterlens.streaming import dedup

UC = "UC" + "a1_-" * 5 + "xy"
URLS = [
    ("https://m.facebook.com/Some.One", "facebook", "Some.One", "handle"), ("https://www.facebook.com/profile.php?id=42&sk=about", "facebook", "42", "numeric_id"),
    ("https://facebook.com/pages/Some/123", "facebook", "123", "numeric_id"), ("https://x.com/i/user/77", "twitter", "77", "numeric_id"), ("twitter.com/@ab", "twitter", "ab", "handle"),
    (f"https://youtube.com/channel/{UC}", "youtube", UC, "channel_id"), ("https://youtube.com/c/ab", "youtube", "ab", "handle"), ("//youtube.com/@ab", "youtube", "ab", "handle"),
    ("https://tiktok.com/@ab?lang=en", "tiktok", "ab", "handle"), ("https://imdb.com/name/NM0000138/?ref_=x", "imdb", "nm0000138", "nm_id"),
    ("https://hi.wikipedia.org/wiki/%E0%A4%95_x", "wikipedia", "क x", "page_title"), ("https://linkedin.com/company/ab", "linkedin", "ab", "company"), ("https://instagr.am/@ab/", "instagram", "ab", "handle"),
    ("https://instagram.com/p/x", None, None, None), ("https://x.com/i/status/1", None, None, None), ("https://youtube.com/watch?v=1", None, None, None), ("https://tiktok.com/tag/x", None, None, None),
    ("https://linkedin.com/feed/", None, None, None), ("https://facebook.com/groups/x", None, None, None), ("https://en.wikipedia.org/wiki/Category:X", None, None, None), ("https://youtu.be/abc", None, None, None),
    ("https://imdb.com/title/tt1", None, None, None), ("https://netflix.com/x", None, None, None), ("", None, None, None), (None, None, None, None), ("https://x.com/", None, None, None),
]


def test_classify_url(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "i int, u string").withColumn("r", urls.classify_url(F.col("u")))
    got = [(r.u, r.platform, r.handle, r.id_kind) for r in df.select("i", "u", "r.*").sort("i").collect()]
    assert got == URLS
    # what is classified is classified the same by its canonical form
    again = df.filter("r IS NOT NULL").select("r.*").withColumn("c", urls.classify_url(F.col("canonical_url")))
    assert again.filter("NOT (c.platform <=> platform AND c.handle <=> handle)").count() == 0


@pytest.mark.parametrize(("raw", "normal"), [("A. R. Rahman", "a r rahman"), ("A.R. Rahman", "a r rahman"), ("Dr. A. R. Rahman", "a r rahman"), ("AR Rahman", "ar rahman"), ("Beyoncé Knowles", "beyonce knowles"), ("Robert Downey Jr.", "robert downey"), ("Simon & Garfunkel", "simon and garfunkel"), ("Dr.", ""), ("", ""), (None, None), ("शाहरुख़ ख़ान", "श हर ख ख न")])
def test_normalize(spark, raw, normal):
    assert spark.createDataFrame([(raw,)], "x string").select(names.normalize(F.col("x"))).first()[0] == normal


def test_names(spark):
    row = spark.sql("SELECT 'allah rakha rahman' a, 'Алла Пугачёва' b, 'शाहरुख़ ख़ान' c, 'マイケル・ジャクソン' d, 'Cash Cobain' e")
    got = row.select(names.initials_form(F.col("a")), names.script_of(F.col("b")), names.script_of(F.col("c")), names.search_languages(F.col("c")), names.script_of(F.col("d")), urls.handle_candidates(F.col("e"))).first()
    assert got[:3] == ("a r rahman", "cyrillic", "devanagari") and got[3] == ["hi", "mr", "ne", "sa", "en"] and got[4] == "katakana"
    assert got[5] == ["cashcobain", "cash_cobain", "cashcobainmusic"]


def test_label_tiers_and_ratio(spark):
    df = spark.createDataFrame([("Ann Lee", "Ann Lee"), ("Ann Lee", "ann, lee"), ("A. Lee", "Ann Lee"), ("Lee Ann", "Ann Lee"), ("Michael Jackson", "Janet Jackson"), ("", "x")], "a string, b string")
    t = names.label_tier(F.col("a"), F.col("b"), names.normalize_stripped(F.col("a")), names.normalize_stripped(F.col("b")))
    got = df.select(t["score"], t["how"], names.sequence_ratio("a", "b")).collect()
    assert [(r[0], r[1]) for r in got] == [(1.0, "exact"), (0.97, "normalized"), (0.9, "initials"), (0.88, "token"), (None, None), (0.0, "none")]
    assert 0 < got[4][2] < 0.8


TIERS = [([5], 0.0, "reject"), ([2], 0.45, "review"), ([1], 0.55, "review"), ([4], 0.38, "review"), ([3], 0.78, "accept"), ([1, 4], 0.721, "review"), ([2, 4], 0.659, "review"), ([1, 3], 0.901, "accept"), ([1, 2, 4], 0.847, "accept"), ([1, 1], 0.58, "review")]


def test_confidence(spark):
    rows = [(i, t, False) for i, (tiers, _, _) in enumerate(TIERS) for t in tiers] + [(99, 2, True), (98, None, None)]
    got = {r.k: (r.confidence, r.verdict) for r in evidence.claim_confidence(spark.createDataFrame(rows, "k int, tier int, authoritative boolean"), ["k"]).collect()}
    assert [got[i] for i in range(len(TIERS))] == [(c, v) for _, c, v in TIERS]
    assert got[99][0] >= 0.8 and got[98][1] == "reject"


def test_back_links(spark):
    links = spark.createDataFrame([("e", "a", "b"), ("e", "b", "a"), ("e", "a", "c"), ("e", "a", "a"), ("f", "a", "b")], "e string, src string, dst string")
    claims = spark.createDataFrame([("e", "a"), ("e", "b"), ("e", "c")], "e string, key string")
    assert sorted((r.src, r.dst) for r in evidence.back_links(links, claims, "e").collect()) == [("a", "b"), ("b", "a")]
    assert evidence.back_links(links, claims, "e", mutual=False).count() == 3


def test_rank(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (2, "a", 0.9), (2, "b", 0.5), (3, "a", 0.5), (3, "b", 0.5), (4, "a", -0.1), (4, "b", -0.5)], "r int, c string, s double")
    got = {x.r: (x.top, x.decision, x.gap) for x in ranking.rank(df, "r", "s", "c").collect()}
    assert got == {1: ("a", "resolved", None), 2: ("a", "resolved", 0.4), 3: ("a", "disambiguate", 0.0), 4: ("a", "disambiguate", 0.4)}
    assert sorted((x.r, x.c) for x in ranking.first_of(df, ["r"], ["s", "c"]).collect()) == [(1, "a"), (2, "b"), (3, "a"), (4, "b")]


def test_resolution_of_namesakes(spark):
    cand = spark.createDataFrame([("Q1", "Michael Jackson", ["musician"], ["US"], 1958, 2009, {"a": "1"}), ("Q2", "Michael Jackson", ["athlete"], ["US"], 1973, None, None), ("Q3", "Michael Jackson", ["writer"], None, 1942, 2007, None)], "entity_id string, label string, roles array<string>, citizenship array<string>, birth_year int, death_year int, external_ids map<string,string>")
    req = spark.createDataFrame([(1, "Michael Jackson", "musician", None, 2005), (2, "michael jackson", "athlete", None, 2000), (3, "Michael Jackson", None, None, None), (4, "Michael Jackson", "politician", None, None), (5, None, None, None, None)], "id int, name string, role string, country string, year int")
    pairs = resolve.recall(req.filter("name IS NOT NULL"), "id", "name", cand, "entity_id", "label")
    got = {r.id: (r.top, r.decision) for r in ranking.rank(resolve.scored(pairs, req, cand, "id", "entity_id", "name", "label"), "id", "role_score", "entity_id").collect()}
    assert got[1] == ("Q1", "resolved") and got[2] == ("Q2", "resolved") and got[3][1] == "disambiguate" and got[4][1] == "disambiguate" and 5 not in got


def test_extraction(spark):
    page = """<html><script id="__NEXT_DATA__" type="application/json">{"a":["https://x.com/ab","see https://tiktok.com/@ab."]}</script><a href="https://x.com/ab">1</a><a href='https://imdb.com/name/nm0000138'>two words</a>
    <script type="application/ld+json">{"sameAs":["https://instagram.com/ab"],"n":{"sameAs":"https://x.com/ab"}}</script></html>"""
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    got = df.select(extract.extract_links(F.col("h")), extract.visible_words(F.col("h"))).collect()
    assert got[0][0] == ["https://x.com/ab", "https://tiktok.com/@ab", "https://instagram.com/ab", "https://imdb.com/name/nm0000138"] and got[0][1] == 3
    assert got[1] == ([], 0) and got[2] == ([], 0)
    j = spark.createDataFrame([('{"sameAs":["u","v"],"n":[{"sameAs":"w"}]}',), ("broken",), (None,)], "j string")
    assert [sorted(r[0]) for r in j.select(extract.same_as("j")).collect()] == [["u", "v", "w"], [], []]
    assert [r[0] for r in j.select(extract.json_strings("j")).collect()] == [["u", "v", "w"], [], []]
    item = '{"labels":{"en":{"value":"A"}},"aliases":{"en":[{"value":"B"},{"value":"A"}]},"claims":{"P31":[{"mainsnak":{"datavalue":{"value":{"id":"Q5"}}}},{"mainsnak":{}}],"P569":[{"mainsnak":{"datavalue":{"value":{"time":"+1967-01-06T00:00:00Z"}}}}]}}'
    i = spark.createDataFrame([(item,), (None,)], "x string").select(extract.item_labels(F.col("x")), extract.item_ids(F.col("x"), "P31"), extract.item_year(F.col("x"), "P569")).collect()
    assert i[0] == (["A", "B"], ["Q5"], 1967)


def test_urls_by_themselves(spark):
    df = spark.createDataFrame([("https://x.org/a?api_key=1&b=2&TOKEN=&key",)], "u string")
    assert df.select(urls.redact(F.col("u"))).first()[0] == "https://x.org/a?api_key=REDACTED&b=2&TOKEN=REDACTED&key="
    w = spark.createDataFrame([("https://en.wikipedia.org/wiki/Cash_Cobain",), ("https://zh-yue.wikipedia.org/wiki/A%2Bb",), ("https://x.com/a",)], "u string").select(urls.wikipedia_site(F.col("u")).alias("w")).collect()
    assert w[0].w == ("enwiki", "Cash Cobain") and w[1].w == ("zh_yuewiki", "A+b") and w[2].w is None


def test_sheets(spark, tmp_path):
    heads = ["Sr. No.", "Talent Name", "Title Category", "Campaign Year", "Market", "Follower Count 2024", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string").sort("i").select(ingest.canon_header(F.col("h"), strict=True)).collect()]
    assert got == ["row_id", "name", "role", "active_year", "country", None, None, None]
    y = spark.createDataFrame([("2005.0",), ("not a year",), ("1799",), (None,), ("99999999999",)], "y string").select(ingest.coerce_year(F.col("y"))).collect()
    assert [r[0] for r in y] == [2005, None, None, None, None]
    r = spark.createDataFrame([("Singer",), ("astronaut",), (None,), ("  CEO ",)], "y string").select(ingest.canon_role(F.col("y"))).collect()
    assert [x[0] for x in r] == ["musician", None, None, "executive"]
    (tmp_path / "a.csv").write_text('id;name\n1;"A;B"\n2;C\n')
    assert [(x.id, x.name) for x in sheets.read_sheet(spark, str(tmp_path / "a.csv")).collect()] == [("1", "A;B"), ("2", "C")]
    assert sheets.sniff_delimiter("a") == ","


def test_state(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, None)], "k string, t int, v string")
    assert sorted((r.k, r.v) for r in store.latest(df, ["k"], ["t"]).collect()) == [("k", "b"), ("m", None)]
    new = spark.createDataFrame([("k", 9, "z"), ("n", 1, "y")], "k string, t int, v string")
    assert sorted((r.k, r.t) for r in store.upsert(store.latest(df, ["k"], ["t"]), new, ["k"]).collect()) == [("k", 9), ("m", 1), ("n", 1)]
    split = store.batch_split(df.withColumn("g", F.lit(1)), "g", ["k", "t"], 1, F.col("v").isNotNull())
    assert sorted((r.k, r.t, r.status) for r in split.collect()) == [("k", 1, "processed"), ("k", 2, "unprocessed"), ("m", 1, "skipped")]
    assert cache.fixture(spark.createDataFrame([("http://a/b",), ("http://c",)], "url string"), [("a/b", "1"), ("a", "2")]).sort("url").select("body").collect() == [("1",), (None,)]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-02 00:00:00")], "k string, t string").selectExpr("k", "CAST(t AS timestamp) AS t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    q = dedup.dedup_stream(stream, ["k"], "t").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.k for r in spark.table("once").collect()) == ["a", "b"]
    q = dedup.windowed_counts(stream, "t", ["k"]).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["count"] for r in spark.table("counts").collect()) == [1, 2]
