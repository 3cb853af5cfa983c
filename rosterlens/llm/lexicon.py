"""Other names under which entries of the reference lists are typed.

Names of countries in other languages and their codes come from the Unicode locale data and ISO 3166 tables of the Java
runtime. What these do not hold, and everyday synonyms of occupations, are given here as fixed values: dictionary words in plain
text, one entry a line, ``entry: name; name``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .canonical import normal_form

#: Languages in which the name of every country is known, besides those spoken there.
EVERYWHERE = ["en", "fr", "es", "de"]

# Synonyms and translations of occupations.
ROLES = """
actor: actress; acteur; actrice; schauspieler; schauspielerin; attore; thespian
film actor: movie actor; film actress; movie actress; screen actor
voice actor: voice artist; voice over artist; vo artist; voice actress
stage actor: theatre actor; theater actor; theatre actress; theater actress; stage actress
film director: movie director; filmmaker; film maker
film producer: movie producer
screenwriter: scriptwriter; screen writer; script writer
singer: vocalist; lead singer; chanteur
composer: film composer; music composer; compositor
songwriter: song writer; lyricist
record producer: music producer
drummer: drum player
violinist: violin player
disc jockey: dj; deejay
footballer: football player; soccer player
cricketer: cricket player
tennis player: tennis pro
basketball player: basketballer
swimmer: competitive swimmer
racing driver: race car driver; race driver; formula 1 driver; f1 driver
youtuber: youtube creator; yt creator; youtube personality
streamer: live streamer; game streamer; twitch streamer
podcaster: podcast host
fashion model: runway model; catwalk model
photographer: photog
journalist: journo; reporter; periodista; journaliste
news presenter: news anchor; newsreader; newscaster
columnist: newspaper columnist
politician: político; politiker; elected politician
diplomat: career diplomat
novelist: novel writer; fiction writer
poet: poetess; dichter; poeta
playwright: dramatist
chief executive: ceo; chief executive officer; chief exec
entrepreneur: startup founder; business founder
comedian: comic; comedienne; stand up comedian; stand up comic
magician: illusionist
chef: head cook; celebrity chef; cook
pastry chef: pâtissier; pâtissière
"""

# Informal, formal and romanised names of countries that the locale data lack.
COUNTRIES = """
India: bharat
United States: u s; u s a; america; the states
United Kingdom: u k; great britain; britain; england; scotland; wales
Japan: nippon; nihon
South Korea: s korea; rok; korea; korea south; republic of korea
North Korea: n korea; dprk; korea north
France: french republic; république française
Germany: ger; federal republic of germany
Greece: hellas; hellenic republic
Nigeria: federal republic of nigeria
China: prc; p r china; people's republic of china; zhongguo
Russia: russian federation; rossiya
Netherlands: the netherlands; holland
United Arab Emirates: u a e; uae; emirates
Saudi Arabia: k s a; ksa; kingdom of saudi arabia
Ireland: republic of ireland
Iran: islamic republic of iran; persia
Thailand: siam
Indonesia: republic of indonesia
Philippines: the philippines; pilipinas
Ukraine: the ukraine
Czechia: czech republic; czech rep
Slovakia: slovak republic
Egypt: misr
Morocco: al maghrib
South Africa: s africa; rsa; republic of south africa
New Zealand: n zealand; aotearoa
Vietnam: viet nam
Sri Lanka: ceylon
Dominican Republic: dominican rep
Côte d'Ivoire: ivory coast
"""


def _entries(text: str) -> list[tuple[str, str]]:
    return [(entry.strip(), name.strip()) for line in text.strip().splitlines() for entry, _, names in [line.partition(":")] for name in names.split(";")]


_named: dict[str, tuple[str, list[str]]] = {}


def _locales(spark: SparkSession) -> dict[str, tuple[str, list[str]]]:
    """Normal form of every country's English name -> (ISO code, languages spoken there)."""
    if not _named:
        locale = spark._jvm.java.util.Locale
        spoken: dict[str, set[str]] = {}
        for tag in map(str, locale.getAvailableLocales()):
            language, *rest = tag.partition("_#")[0].split("_")
            for part in rest:
                if len(part) == 2 and part.isupper():
                    spoken.setdefault(part, set()).add(language)
        english = locale("en")
        for code in locale.getISOCountries():
            _named[normal_form(locale("", code).getDisplayCountry(english))] = (code, sorted(spoken.get(code, set())))
    return _named


def country_names(spark: SparkSession, names: list[str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(name, other name) pairs of the countries of a list: their names in other languages, and their codes."""
    locale, known = spark._jvm.java.util.Locale, _locales(spark)
    other, codes = [], []
    for name in names:
        code, languages = known.get(normal_form(name), (None, []))
        if code is None:
            continue
        there = locale("", code)
        codes += [(name, code), (name, there.getISO3Country())]
        other += [(name, there.getDisplayCountry(locale(x))) for x in [*EVERYWHERE, *(x for x in languages if x not in EVERYWHERE)]]
    return other, codes


def aliases(field: str) -> list[tuple[str, str]]:
    """(entry, other name) of the fixed values for ``role`` or ``country``."""
    return _entries(ROLES if field == "role" else COUNTRIES)
