"""URL functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Platforms in their order, routes that are never handles, hosts of each platform, tracking parameters.
PLATFORMS = ["facebook", "instagram", "twitter", "youtube", "wikipedia", "imdb", "tiktok", "linkedin"]
RESERVED = {
    "instagram": ["p", "reel", "reels", "explore", "stories", "tv", "accounts", "direct", "about", "developer", "legal", "privacy", "help"],
    "facebook": ["pages", "groups", "events", "watch", "marketplace", "photo", "photo.php", "story.php", "profile.php", "sharer", "login", "help", "policies", "permalink.php", "media", "hashtag"],
    "twitter": ["i", "home", "search", "explore", "hashtag", "intent", "share", "settings", "messages", "notifications", "compose"],
    "tiktok": ["tag", "music", "discover", "foryou", "explore", "live", "legal", "about", "upload"],
    "linkedin": ["feed", "jobs", "learning", "pulse", "posts", "help", "legal", "checkpoint", "authwall", "signup", "login"],
    "youtube": ["watch", "playlist", "results", "feed", "shorts", "hashtag", "about", "redirect", "channel", "user", "c"],
}
HOSTS = {
    "instagram": ["instagram.com", "instagr.am"],
    "facebook": ["facebook.com", "fb.com", "fb.me"],
    "twitter": ["twitter.com", "x.com"],
    "youtube": ["youtube.com", "youtu.be"],
    "tiktok": ["tiktok.com"],
    "linkedin": ["linkedin.com"],
    "imdb": ["imdb.com"],
    "wikipedia": ["wikipedia.org"],
}
TRACKING = ["utm_", "fb", "ig", "_r", "_t", "si", "gclid", "mc_"]
NO_ARTICLE = ["File", "Category", "Template", "Help", "Special", "Talk"]
NO_ITEM = [*NO_ARTICLE, "Portal", "Wikipedia", "Draft"]
SECRETS = ["api_key", "apikey", "key", "token", "access_token"]
AGGREGATORS = [
    "linktr.ee", "beacons.ai", "bio.link", "allmylinks.com", "solo.to", "taplink.cc", "linkr.bio", "lnk.bio",
    "linkin.bio", "komi.io", "hoo.be", "stan.store", "direct.me", "shorby.com", "campsite.bio", "flowcode.com",
    "znap.link", "carrd.co", "about.me", "milkshake.app", "tap.bio", "withkoji.com",
]
ALLOWED = [
    "wikidata.org", "wikipedia.org", "musicbrainz.org", "themoviedb.org", "imdb.com", "instagram.com", "facebook.com", "twitter.com", "x.com",
    "youtube.com", "tiktok.com", "linkedin.com", "open.spotify.com", *AGGREGATORS, "serpapi.com", "omdbapi.com", "thesportsdb.com",
    "openlibrary.org", "viaf.org", "orcid.org", "api.deezer.com", "itunes.apple.com",
]
#: Least seconds between two calls to a host.
HOST_GAPS = {
    "musicbrainz.org": 1.1, "query.wikidata.org": 1.5, "www.wikidata.org": 0.4, "api.themoviedb.org": 0.06, "serpapi.com": 0.5, "viaf.org": 0.5,
    "openlibrary.org": 0.5, "www.thesportsdb.com": 0.5, "www.omdbapi.com": 0.2,
}
DEFAULT_GAP = 1.0


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def absolute(url: Column) -> Column:
    """The trimmed URL with a scheme."""
    u = F.trim(url)
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    return F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))


def _host(a: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(a, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^\.+", "")


def _bare_host(a: Column) -> Column:
    return F.regexp_replace(_host(a), r"^(?:m|mobile)\.", "")


def _parts(a: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(a, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")


def _kept_params(a: Column) -> Column:
    banned = "|".join(TRACKING)
    return F.filter(F.split(F.regexp_extract(a, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p.rlike("=.") & ~p.rlike(f"(?i)^(?:{banned})"))


def host(url: Column) -> Column:
    """Lower-cased host without leading dots; never null for a URL that is not null."""
    return _host(absolute(url))


def bare_host(url: Column) -> Column:
    """The host without one mobile prefix."""
    return _bare_host(absolute(url))


def path(url: Column) -> Column:
    return F.regexp_extract(absolute(url), r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)


def parts(url: Column) -> Column:
    return _parts(absolute(url))


def kept_params(url: Column) -> Column:
    """Parameters that are not blank and not for tracking, in their order. Prefixes match longer names too."""
    return _kept_params(absolute(url))


def canonical_form(url: Column) -> Column:
    """https, host without mobile prefix, path without a final slash, kept parameters, no fragment."""
    params = F.array_join(kept_params(url), "&")
    p = F.regexp_replace(path(url), "/+$", "")
    return F.concat(F.lit("https://"), bare_host(url), p, F.when(params == "", F.lit("")).otherwise(F.concat(F.lit("?"), params)))


def unquote(s: Column) -> Column:
    """Percent-decoding that leaves malformed escapes and plus signs as they are."""
    s = F.regexp_replace(s, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.regexp_replace(s, r"\+", "%2B"))


def param(kept: Column, name: str) -> Column:
    """The decoded value of a parameter out of kept_params, the first if there are several."""
    got = F.try_element_at(F.filter(kept, lambda p: p.startswith(f"{name}=")), F.lit(1))
    return unquote(F.regexp_replace(F.regexp_replace(got, f"^{name}=", ""), r"\+", " "))


def on(h: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or lies below one."""
    return h.rlike(r"(?:^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")


def platform(url: Column) -> Column:
    """The platform of the URL's host, null for other hosts."""
    return let(bare_host(url), _platform)


def _platform(h: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, domains in reversed(HOSTS.items()):
        out = F.when(on(h, domains), F.lit(name)).otherwise(out)
    return out


def _unless_reserved(x: Column, name: str) -> Column:
    return F.when((x != "") & ~F.lower(x).isin(RESERVED[name]), x)


def classify_url(url: Column) -> Column:
    """struct(platform, handle, id_kind, lang, canonical_url, raw_url), null for what is no account."""
    split = let(absolute(url), lambda a: F.struct(_bare_host(a).alias("h"), _parts(a).alias("p"), _kept_params(a).alias("kept")))
    placed = let(split, lambda s: F.struct(s["h"], s["p"], s["kept"], _platform(s["h"]).alias("name")))
    named = let(placed, _account)

    def ref(x: Column) -> Column:
        r = F.struct(x["name"].alias("platform"), x["handle"].alias("handle"), x["kind"].alias("id_kind"), x["lang"].alias("lang"), build_url(x["name"], x["handle"], x["lang"], x["kind"]).alias("canonical_url"), url.alias("raw_url"))
        return F.when(x["handle"].isNotNull() & (x["handle"] != ""), r)

    return let(named, ref)


def _account(s: Column) -> Column:
    """struct(name, handle, kind, lang) of a URL taken apart."""
    h, p, name = s["h"], s["p"], s["name"]
    at = lambda i: F.try_element_at(p, F.lit(i))
    first, second, size = at(1), at(2), F.size(p)
    no_at = F.regexp_replace(first, "^@", "")
    fb_numeric = (size >= 3) & (first == "pages") & F.try_element_at(p, F.lit(-1)).rlike("^[0-9]+$")
    yt = (
        F.when(on(h, ["youtu.be"]), F.lit(None))
        .when((first == "channel") & second.isNotNull(), second)
        .when(first.isin("c", "user") & second.isNotNull(), second)
        .when(first.startswith("@"), F.nullif(F.regexp_replace(first, "^@", ""), F.lit("")))
        .when(F.lower(first).isin(RESERVED["youtube"]), F.lit(None))
        .when(first.rlike("^UC[0-9A-Za-z_-]{22}$"), first)
    )
    imdb = F.lower(F.nullif(F.regexp_extract(F.array_join(p, "/"), r"(?i)\b(nm\d{5,10})\b", 1), F.lit("")))
    sub = F.substring_index(h, ".", 1)
    lang = F.when(sub.isin("www", "wikipedia"), F.lit("en")).otherwise(sub)
    title = F.when((first == "wiki") & (size >= 2), F.array_join(F.slice(p, 2, F.greatest(size - 1, F.lit(1))), "/")).when(first == "w", param(s["kept"], "title"))
    title = F.trim(F.regexp_replace(unquote(title), "_", " "))
    title = F.when((title != "") & ~(F.substring_index(title, " ", 1).contains(":") & F.substring_index(title, ":", 1).isin(NO_ARTICLE)), title)
    handles = {
        "instagram": (_unless_reserved(no_at, "instagram"), F.lit("handle")),
        "facebook": (
            F.when(first == "profile.php", param(s["kept"], "id")).when(fb_numeric, F.try_element_at(p, F.lit(-1))).otherwise(_unless_reserved(first, "facebook")),
            F.when((first == "profile.php") | fb_numeric, F.lit("numeric_id")).otherwise(F.lit("handle")),
        ),
        "twitter": (
            F.when((first == "i") & (second == "user") & (size >= 3), at(3)).otherwise(_unless_reserved(no_at, "twitter")),
            F.when((first == "i") & (second == "user"), F.lit("numeric_id")).otherwise(F.lit("handle")),
        ),
        "youtube": (yt, F.when(yt.rlike("^UC[0-9A-Za-z_-]{22}$") & ~F.coalesce(first.startswith("@"), F.lit(False)), F.lit("channel_id")).otherwise(F.lit("handle"))),
        "tiktok": (F.when(first.startswith("@"), _unless_reserved(F.regexp_replace(first, "^@", ""), "tiktok")), F.lit("handle")),
        "linkedin": (F.when((first == "in") & second.isNotNull(), second).when(first.isin("company", "school") & second.isNotNull(), second), F.when(first == "in", F.lit("handle")).otherwise(F.lit("company"))),
        "imdb": (imdb, F.lit("nm_id")),
        "wikipedia": (title, F.lit("page_title")),
    }
    handle = F.coalesce(*[F.when(name == k, v) for k, (v, _) in handles.items()])
    kind = F.coalesce(*[F.when(name == k, v) for k, (_, v) in handles.items()])
    return F.struct(name.alias("name"), handle.alias("handle"), kind.alias("kind"), F.when(name == "wikipedia", lang).alias("lang"))


def build_url(platform: Column, handle: Column, lang: Column | None = None, id_kind: Column | None = None) -> Column:
    """The canonical URL of an account; of an unknown platform null."""
    kind = F.lit("handle") if id_kind is None else F.coalesce(id_kind, F.lit("handle"))
    lang = F.lit("en") if lang is None else F.coalesce(lang, F.lit("en"))
    h = F.regexp_replace(handle, "^@", "")
    return (
        F.when((platform == "facebook") & (kind == "numeric_id"), F.concat(F.lit("https://www.facebook.com/profile.php?id="), h))
        .when(platform == "facebook", F.concat(F.lit("https://www.facebook.com/"), h))
        .when(platform == "instagram", F.concat(F.lit("https://www.instagram.com/"), h, F.lit("/")))
        .when((platform == "twitter") & (kind == "numeric_id"), F.concat(F.lit("https://x.com/i/user/"), h))
        .when(platform == "twitter", F.concat(F.lit("https://x.com/"), h))
        .when((platform == "youtube") & h.rlike("^UC[0-9A-Za-z_-]{22}$"), F.concat(F.lit("https://www.youtube.com/channel/"), h))
        .when(platform == "youtube", F.concat(F.lit("https://www.youtube.com/@"), h))
        .when(platform == "tiktok", F.concat(F.lit("https://www.tiktok.com/@"), h))
        .when((platform == "linkedin") & (kind == "company"), F.concat(F.lit("https://www.linkedin.com/company/"), h, F.lit("/")))
        .when(platform == "linkedin", F.concat(F.lit("https://www.linkedin.com/in/"), h, F.lit("/")))
        .when(platform == "imdb", F.concat(F.lit("https://www.imdb.com/name/"), F.lower(h), F.lit("/")))
        .when(platform == "wikipedia", F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), F.regexp_replace(handle, " ", "_")))
    )


def ref_key(platform: Column, handle: Column, lang: Column) -> Column:
    """The case-insensitive key of an account."""
    return F.concat(platform, F.lit(":"), F.lower(handle), F.when(F.coalesce(lang, F.lit("")) != "", F.concat(F.lit("@"), lang)).otherwise(F.lit("")))


def redact(url: Column) -> Column:
    """Values of secret parameters hidden; a bare secret key gets an equals sign."""
    keys = "|".join(SECRETS)
    out = F.regexp_replace(url, rf"(?i)(?<=[?&])({keys})=[^&]*", "$1=REDACTED")
    return F.regexp_replace(out, rf"(?i)(?<=[?&])({keys})(?=&|$)", "$1=")


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def is_aggregator(url: Column) -> Column:
    """Whether the host is a link-in-bio service."""
    return on(F.regexp_replace(host(url), r"^www\.", ""), AGGREGATORS)


def handle_candidates(name: Column, limit: int = 4) -> Column:
    """Slugs a name may go under, in order of likelihood."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", "")), " +"), lambda x: x != "")
    joined = F.array_join(words, "")
    more = F.array(joined, F.array_join(words, "_"), F.concat(joined, F.lit("music")), F.concat(F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))))
    out = F.when(F.size(words) > 1, more).otherwise(F.array(joined))
    return F.slice(F.array_distinct(F.filter(out, lambda h: F.length(h).between(3, 40))), 1, limit)


def is_allowed(url: Column) -> Column:
    """Whether the host may be fetched: one of ALLOWED or below one."""
    return on(host(url), ALLOWED)


def host_gap(h: Column) -> Column:
    """The least seconds between two calls to a host: of the first entry it ends with."""
    out = F.lit(DEFAULT_GAP)
    for suffix, gap in reversed(HOST_GAPS.items()):
        out = F.when(h.endswith(suffix), F.lit(gap)).otherwise(out)
    return out


def probe_urls(handle: Column) -> Column:
    """Where a handle's page would be on each link-in-bio service; none for what cannot be a handle."""
    pages = F.array(*[F.concat(F.lit(f"https://{d}/"), handle) for d in AGGREGATORS])
    return F.when(handle.rlike(r"^[A-Za-z0-9._\-]{2,40}$"), pages).otherwise(F.array().cast("array<string>"))


def wikipedia_site(url: Column) -> Column:
    """struct(site, title) of an article's URL, null for others and for pages of other namespaces."""
    h, p = host(url), parts(url)
    sub = F.substring_index(h, ".", 1)
    lang = F.regexp_replace(F.when(sub.isin("www", "wikipedia", "m"), F.lit("en")).otherwise(sub), "-", "_")
    title = F.trim(F.regexp_replace(unquote(F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), "/")), "_", " "))
    ok = h.endswith("wikipedia.org") & (F.try_element_at(p, F.lit(1)) == "wiki") & (F.size(p) >= 2) & (title != "")
    return F.when(ok & ~F.substring_index(title, ":", 1).isin(NO_ITEM), F.struct(F.concat(lang, F.lit("wiki")).alias("site"), title.alias("title")))
