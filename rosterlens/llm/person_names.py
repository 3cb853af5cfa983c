"""Taking person names apart: script, titles, order, given name, surname, in a folded spelling that compares across scripts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

# Titles, suffixes and particles around names.
TITLES = set("mr mrs ms miss dr prof professor sir dame lady lord phd md jr sr ii iii iv esq official the".split())
PARTICLES = set("van von de da di del della der den la le al el bin ibn dos du".split())

# Familiar short forms of given names, one given name a line.
NICKNAMES = """
abigail: abby gail; adrian: ade; alexander: alex sasha xander aleksandr; alexandra: alex sasha lexi sandra; andrew: andy drew; anna: annie anya
anthony: tony ant; barbara: barb babs barbie; beatrice: bea trixie; beatriz: bea bia; benjamin: ben benny benji; catherine: cathy kate katie
charles: charlie chuck chaz; christina: tina chris chrissy; christopher: chris kit topher; cordelia: cordy delia; daniel: dan danny
deborah: debbie deb debra; desmond: des dez; dmitri: dima mitya; dorothy: dot dottie dolly; edward: ed eddie ted ned; eleanor: ellie nell nora
elizabeth: liz beth lizzie betty eliza; emily: em emmy; esperanza: espe; fernando: nando fer; frances: fran frankie franny; francesca: fran chesca
frederick: fred freddie freddy; gabrielle: gabby gabi; gerald: gerry jerry; giovanni: gianni vanni; gregory: greg; guadalupe: lupe lupita
imogen: immy; jacqueline: jackie jacqui; james: jim jimmy jamie; jennifer: jen jenny jenn; john: jack johnny; jonathan: jon jonny johnny
jose: pepe; joseph: joe joey; josephine: jo josie; katherine: kate kathy katie kat; kenneth: ken kenny; lawrence: larry laurie; lakshmi: laxmi
leonard: leo lenny; lorenzo: enzo renzo; ludmila: luda mila lyuda; margaret: maggie meg peggy; matthew: matt; matteo: teo; michael: mike mick mikey misha
mikhail: misha; monica: moni; natalia: natasha talia nat; nathaniel: nat nate; nicholas: nick nicky nico; nikhil: nik; patricia: pat patty trish tricia
patrick: pat paddy rick; penelope: penny; percival: percy; philip: phil pip; priyam: pri; rebecca: becky becca; richard: rick dick rich ricky
robert: rob bob bobby robbie bert; rodrigo: rodri; ronald: ron ronnie; rupert: rupe; samantha: sam sammy; samuel: sam sammy; sergei: seryozha serge
stephen: steve; susan: sue susie suzy; svetlana: sveta lana; tatiana: tanya tati; theodore: ted theo teddy; theresa: terry tess tessa; thomas: tom tommy
timothy: tim timmy; veronica: ronnie vera nica; victoria: vicky tori vic; vikram: vik vicky; vladimir: vova vlad volodya; wilhelmina: mina
william: will bill billy liam; winifred: winnie freddie; wolfgang: wolfi wolf; alexander: alexdr; benjamin: benj; charles: chas; daniel: danl; edward: edw; elizabeth: eliz; frederick: fredk; james: jas; john: jno
jonathan: jona; joseph: jos; margaret: margt; nicholas: nichs; patrick: patk; richard: richd; robert: robt; samuel: saml; thomas: thos; timothy: timy
william: wm willm; xavier: xavi; yamini: yami; ximena: xime mena; zachary: zach
"""

CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", "a b v g d e e zh z i i k l m n o p r s t u f h ts ch sh sh _ i _ e iu ia i i e g".replace("_", "").split(" "), strict=True))
DEVANAGARI = dict(zip("कखगघचछजझटठडढतथदधनणञङपफबभमयरलवशषसह", "k h g g ch ch j zh t t d d t t d d n n n n p f b b m i r l v sh sh s h".split(), strict=True)) | dict(zip("अआइईउऊएऐओऔ", "a a i i u u e ai o ou".split(), strict=True)) | dict(zip("ािीुूेैोौ", "a i i u u e ai o ou".split(), strict=True))
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i", "ħ": "h", "ŋ": "n"})
_SOUNDS = [("dzh", "j"), ("sch", "sh"), ("tch", "ch"), ("ph", "f"), ("th", "t"), ("kh", "h"), ("gh", "g"), ("ck", "k")]
#: Letters, and marks and joiners that belong to them; hyphens and apostrophes within a word.
_LETTER = "(?:[^\\W\\d_]|[\u0300-\u036f\u0900-\u0963\u200c\u200d])"
_WORD = re.compile(f"{_LETTER}+(?:['’\\-‑]{_LETTER}+)*")
_INDIC = re.compile("[\u0900-\u097f]")
_QUOTED = re.compile(r"[\"“”«»][^\"“”«»]*[\"“”«»]|\([^)]*\)|（[^）]*）")


@lru_cache(200_000)
def fold(token: str) -> str:
    """A token as lower-case Latin letters that sound alike in every script it may be written in."""
    s = "".join(c for c in unicodedata.normalize("NFKD", token.lower()) if not (unicodedata.combining(c) and c != "्") and c not in "‌‍'’-‑")
    s = s.translate(_LETTERS)
    s = "".join(CYRILLIC.get(c, DEVANAGARI.get(c, "" if c == "्" else c)) for c in s)
    for a, b in _SOUNDS:
        s = s.replace(a, b)
    s = re.sub(r"c(?!h)", "k", s).replace("q", "k").replace("x", "ks").replace("w", "v").replace("y", "i")
    return re.sub(r"(.)\1+", r"\1", re.sub(r"ie$", "i", s))


def skeleton(folded: str) -> str:
    """Consonants only: what is left of a name in a script that does not write every vowel."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[aeiou]", "", folded).replace("z", "j").replace("jh", "j"))


_SHORT: dict[str, set[str]] = {}
for _part in NICKNAMES.replace("\n", ";").split(";"):
    if ":" in _part:
        _full, _, _names = _part.partition(":")
        for _n in _names.split():
            _SHORT.setdefault(fold(_n), set()).add(fold(_full.strip()))


def within(a: str, b: str, k: int) -> int | None:
    """Restricted Damerau-Levenshtein distance if it is at most k, else None, computed in a band of 2k+1 diagonals."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return None
    far = k + 1
    before: list[int] = []
    row = [j if j <= k else far for j in range(m + 1)]
    for i in range(1, n + 1):
        new = [far] * (m + 1)
        if i <= k:
            new[0] = i
        ca, least = a[i - 1], new[0]
        for j in range(max(1, i - k), min(m, i + k) + 1):
            cb = b[j - 1]
            d = row[j - 1] + (ca != cb)
            if row[j] + 1 < d:
                d = row[j] + 1
            if new[j - 1] + 1 < d:
                d = new[j - 1] + 1
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            new[j] = d
            if d < least:
                least = d
        if least > k:
            return None
        before, row = row, new
    return row[m] if row[m] <= k else None


def tokens(name: str) -> tuple[list[str], bool]:
    """(folded words without titles and remarks, whether they were in 'Last, First' order)."""
    bare = _QUOTED.sub(" ", name).replace("_", " ")
    front, comma, back = bare.partition(",")
    words = lambda s: [w for w in _WORD.findall(unicodedata.normalize("NFC", s)) if w.lower().strip(".") not in TITLES]
    a, b = words(front), words(back)
    flipped = bool(comma and a and b)
    folded = [(fold(w)[:1] if len(w) == 1 else fold(w)) for w in (b + a if flipped else a + b) if w.lower() not in PARTICLES]
    return [f for f in folded if f], flipped


def _letters(word: str) -> int:
    """Which letters a word holds, as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


class Parser:
    """Takes names apart, knowing how often the words that are common in names occur: given names, but for a few."""

    def __init__(self, common: dict[str, int]):
        self.common = common
        self._near = lru_cache(200_000)(self._nearest)
        self._words = sorted(common)
        self._lengths = np.array([len(c) for c in self._words], np.int64)
        self._letters = np.array([_letters(c) for c in self._words], np.uint64)

    def _nearest(self, token: str) -> str | None:
        """The common given name that the token is, is short for or nearly is."""
        if token in self.common:
            return token
        if short := sorted(_SHORT.get(token, set()) & self.common.keys()):
            return short[0]
        if len(token) >= 5 and len(self._words):
            n = self._lengths
            k = np.where(n >= 7, 2, 1)
            own = np.uint64(_letters(token))
            # an edit changes one letter at most: what lacks more letters of the other is further away
            may = (n >= 4) & (np.abs(n - len(token)) <= k) & (np.bitwise_count(self._letters & ~own) <= k) & (np.bitwise_count(own & ~self._letters) <= k)
            found = [(d, self._words[i]) for i in np.flatnonzero(may).tolist() if (d := within(token, self._words[i], int(k[i]))) is not None]
            return min(found)[1] if found else None
        return None

    def __call__(self, name: str | None) -> tuple[str, str, str] | None:
        """(given name or initial, surname, middle initial), folded; None where there is no surname.

        A given name comes as the common one it is meant for. Of a name in Devanagari only the consonants and the
        beginning are sure: its parts are marked by ``~``, and the surname is its skeleton.
        """
        if not name:
            return None
        words, flipped = tokens(name)
        long = [w for w in words if len(w) > 1]
        if not long:
            return None
        unlike = [w for w in long if self._near(w) is None and w not in _SHORT]
        if not unlike:
            # every word is like a given name: the rarest is the surname, of equally rare ones the last
            rarest = min(self.common.get(self._near(w) or w, 0) for w in long)
            unlike = [[w for w in long if self.common.get(self._near(w) or w, 0) == rarest][-1]]
        surname = max(unlike, key=lambda w: (len(w), w))
        at = words.index(surname)
        rest = words[:at] + words[at + 1 :]
        given = next((w for w in rest if len(w) > 1), rest[0] if rest else "")
        middle = next((w for w in rest if len(w) == 1 and w is not given), "") if len(rest) > 1 else ""
        if _INDIC.search(name):
            return given and "~" + given, "~" + skeleton(surname), middle
        return self._near(given) or given, surname, middle


def initials_agree(a: str, b: str) -> bool:
    """Whether two names may begin with one letter: sounds written with two letters begin with the first of them."""
    return a[0] == b[0] or {a[0], b[0]} in ({"k", "c"}, {"p", "f"}, {"k", "h"}, {"j", "z"}, {"i", "j"})


def given_names_agree(a: str, b: str) -> int | None:
    """How well two given names agree: 3 the same, 2 spelt nearly so or short for it, 1 an initial or missing, None not."""
    if a == b:
        return 3 if a else 1
    if not a or not b:
        return 1
    if a[0] == "~" or b[0] == "~":
        a, b = (x.removeprefix("~") for x in (a, b))
        if 1 in (len(a), len(b)):
            return 1 if initials_agree(a, b) else None
        a, b = skeleton(a), skeleton(b)
        return 2 if a == b or within(a, b, 1) is not None and min(len(a), len(b)) > 2 else None
    if len(a) == 1 or len(b) == 1:
        return 1 if initials_agree(a, b) else None
    sa, sb = _SHORT.get(a, set()), _SHORT.get(b, set())
    if b in sa or a in sb or sa & sb:
        return 2
    if skeleton(a) == skeleton(b) and len(skeleton(a)) >= 2:
        return 2
    if within(a, b, 2 if min(len(a), len(b)) >= 6 else 1) is not None:
        return 2
    for x, shorts in ((a, sb), (b, sa)):
        if any(len(s) >= 5 and within(x, s, 1) is not None for s in shorts):
            return 2
    return None
