"""The authorities whose ids a knowledge-graph item may state, as a small table, with its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Key, label, property, pattern of its pages, field, target platform, whether the property is sure, whether one hit is enough.
AUTHORITIES = [
    ("instagram", "Instagram username", "P2003", "https://www.instagram.com/{id}/", "social", "instagram", True, False),
    ("twitter", "X (Twitter) username", "P2002", "https://x.com/{id}", "social", "twitter", True, False),
    ("twitter_numeric", "X numeric user id", "P6552", "https://x.com/i/user/{id}", "social", "twitter", False, False),
    ("facebook", "Facebook id", "P2013", "https://www.facebook.com/{id}", "social", "facebook", True, False),
    ("facebook_numeric", "Facebook numeric id", "P4003", "https://www.facebook.com/profile.php?id={id}", "social", "facebook", False, False),
    ("youtube_channel", "YouTube channel id", "P2397", "https://www.youtube.com/channel/{id}", "social", "youtube", True, False),
    ("youtube_handle", "YouTube handle", "P11245", "https://www.youtube.com/@{id}", "social", "youtube", False, False),
    ("tiktok", "TikTok username", "P7085", "https://www.tiktok.com/@{id}", "social", "tiktok", True, False),
    ("linkedin", "LinkedIn personal profile id", "P6634", "https://www.linkedin.com/in/{id}/", "professional", "linkedin", False, False),
    ("imdb", "IMDb id", "P345", "https://www.imdb.com/name/{id}/", "film", "imdb", True, True),
    ("wikipedia", "Wikipedia article", None, "https://{lang}.wikipedia.org/wiki/{id}", "reference", "wikipedia", True, True),
    ("spotify_artist", "Spotify artist id", "P1902", "https://open.spotify.com/artist/{id}", "music", None, True, False),
    ("musicbrainz_artist", "MusicBrainz artist id", "P434", "https://musicbrainz.org/artist/{id}", "music", None, True, False),
    ("apple_music_artist", "Apple Music artist id", "P2850", "https://music.apple.com/artist/{id}", "music", None, True, False),
    ("deezer_artist", "Deezer artist id", "P2722", "https://www.deezer.com/artist/{id}", "music", None, True, False),
    ("genius_artist", "Genius artist id", "P2373", "https://genius.com/artists/{id}", "music", None, True, False),
    ("soundcloud", "SoundCloud id", "P3040", "https://soundcloud.com/{id}", "music", None, True, False),
    ("discogs_artist", "Discogs artist id", "P1953", "https://www.discogs.com/artist/{id}", "music", None, True, False),
    ("lastfm", "Last.fm id", "P3192", "https://www.last.fm/music/{id}", "music", None, True, False),
    ("tmdb_person", "TMDB person id", "P4985", "https://www.themoviedb.org/person/{id}", "film", None, True, False),
    ("rotten_tomatoes", "Rotten Tomatoes id", "P1258", "https://www.rottentomatoes.com/{id}", "film", None, True, False),
    ("letterboxd", "Letterboxd id", "P6127", "https://letterboxd.com/{id}/", "film", None, False, False),
    ("twitch", "Twitch channel", "P5797", "https://www.twitch.tv/{id}", "gaming", None, True, False),
    ("transfermarkt_player", "Transfermarkt player id", "P2446", "https://www.transfermarkt.com/-/profil/spieler/{id}", "sport", None, True, False),
    ("espn_player", "ESPN player id", "P8286", None, "sport", None, False, False),
    ("olympedia", "Olympedia athlete id", "P8286", None, "sport", None, False, False),
    ("goodreads_author", "Goodreads author id", "P2963", "https://www.goodreads.com/author/show/{id}", "books", None, False, False),
    ("crunchbase_person", "Crunchbase person id", "P2087", "https://www.crunchbase.com/person/{id}", "business", None, False, False),
    ("orcid", "ORCID id", "P496", "https://orcid.org/{id}", "academia", None, True, False),
]
# The authorities to ask first for each role.
ANCHORS = {
    "musician": ["musicbrainz_artist", "spotify_artist", "wikipedia", "imdb"], "actor": ["tmdb_person", "imdb", "wikipedia"], "director": ["tmdb_person", "imdb", "wikipedia"],
    "creator": ["youtube_channel", "twitch", "wikipedia"], "athlete": ["transfermarkt_player", "wikipedia", "imdb"],
    "executive": ["linkedin", "crunchbase_person", "wikipedia"], "journalist": ["wikipedia", "linkedin", "twitter"], "writer": ["goodreads_author", "wikipedia", "imdb"],
}
ANCHORS_OF_OTHERS = ["wikipedia", "imdb", "tmdb_person"]
SCHEMA = "authority string, label string, property string, template string, domain string, platform string, verified boolean, self_sufficient boolean, place int"


def authorities(spark: SparkSession) -> DataFrame:
    """The authorities in their order; of two that share a property the later counts."""
    return spark.createDataFrame([(*a, i) for i, a in enumerate(AUTHORITIES)], SCHEMA)


def by_property(spark: SparkSession) -> DataFrame:
    """One authority a property."""
    a = authorities(spark).filter("property IS NOT NULL")
    return a.groupBy("property").agg(F.max_by(F.struct("authority", "label", "template", "platform", "self_sufficient", "place"), "place").alias("a")).select("property", "a.*")


def unverified(spark: SparkSession) -> DataFrame:
    """Authorities whose property is yet to be confirmed."""
    return authorities(spark).filter("property IS NOT NULL AND NOT verified").select("authority", "property")


def validated(spark: SparkSession, labels: DataFrame) -> DataFrame:
    """property, ``result``: its English label among ``labels`` (property, lang, label, error), ``?`` if it has other languages only,
    ``MISSING`` if it is not there, ``ERROR: ..`` if it could not be read."""
    told = labels.groupBy("property").agg(F.max(F.when(F.col("lang") == "en", F.col("label"))).alias("label"), F.count("lang").alias("n"), F.max("error").alias("error"))
    j = authorities(spark).filter("property IS NOT NULL").select("property").distinct().join(F.broadcast(told), "property", "left")
    return j.select("property", F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR: "), "error")).when(F.coalesce("n", F.lit(0)) == 0, "MISSING").otherwise(F.coalesce("label", F.lit("?"))).alias("result"))


def anchors(role):
    """The authorities to ask first for a role, as an array."""
    table = F.create_map(*[x for k, v in ANCHORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, F.coalesce(role, F.lit(""))), F.array(*map(F.lit, ANCHORS_OF_OTHERS)))
