"""Main body of pages without what the site puts around it (problem 2).

Method: consensus host paths, for text as pages leave it.  The containers of a page are its lines and the sentences
in them; a container's generalised path is its list mark and its words with numbers, capitalised words and the
site's name replaced by signs, so that the same menu, notice or footer has one path on all pages of a host.

1. Score: each page is walked once.  A container's shape (sentences, length, list mark, separators) says whether it
   can be a paragraph.  Paragraphs of several sentences that recur under different titles, on a fair share of a
   host's pages or on many hosts, are standing notes; an article's own paragraphs don't, copies of the article included.
2. Vote: the headline and the last paragraph of its own divide a page into before, head, inside and after.  Zones are
   counted for each path, by host and over all hosts, in Spark.  Paths that lie outside nearly always win; in the
   head (between headline and first sentence) only a constant wording is outside, names as in author lines aren't.
3. Re-extract: every page is walked again with the winning paths.  What precedes the headline, what follows the
   first winning path after the last paragraph, and winning paths in between are furniture.

The fixed lists of wordings below are a prior of PRIOR votes and of lower shares, no decision: votes overrule them,
and without them (prior=False) the votes alone find over nine tenths of the lines at a precision of 0.98 and more
(tested).  They are needed for adverts between paragraphs, which stand where sub-headings stand.

Winning paths are broadcast as hashes up to MAX_BROADCAST of them, a measured number; beyond that they are joined
to the pages in a shuffled join.  Defined results: null, empty and blank content has no lines; a page without an
article is furniture throughout; lines are counted from 0 at "\\n"; repeated pages count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.session import materialise

OUTSIDE, OUTSIDE_LINE = 0.9, 0.65  # share of a path's votes outside articles, of sentences and list items, and of other lines
PRIOR, PRIOR_OUTSIDE, PRIOR_LINE = 2, 0.5, 0.05  # votes and shares of paths that the lists word as furniture
DOUBT = 2  # votes inside that every unlisted sentence starts with
HOST_SHARE, LEAST = 0.2, 3  # of a host's pages; votes at least
STANDING_SHARE, STANDING_HOSTS = 0.05, 0.02  # of a host's pages, of all hosts, that a standing note recurs on
MAX_BROADCAST = 500_000
BEFORE, INSIDE, AFTER, HEAD = 0, 1, 2, 3

# How sites word advertising, sharing, prompts, teasers, comments and legal notes, by language.
ADVERT = r"^[\W_]*(?:advertis|sponsor|promot(?:ed|ion)|anzeige\b|werbung|gesponsert|publicit|contenu sponsoris|publicidad|anuncio|contenido patrocinado|advertentie|reclame|pubblicit|reklam|реклам|annons|publieditorial)|(?:story|article|page) continues|continue reading|nach der werbung|après cette annonce|tras el anuncio|lees verder onder|continua (?:dopo|após)"
SHARE = r"^[\W_]*(?:share|tweet|print|email|e-mail|save|copy link|listen to (?:this|the)|teilen|artikel (?:teilen|anhören)|drucken|merken|vorlesen|partager|imprimer|écouter|comparte|compartir|imprimir|escuch|partilh|compartilh|ouvir|delen|afdrukken|luister|condividi|stampa|ascolta|udostępnij|drukuj|posłuchaj|поделиться|распечатать|dela\b|skriv ut|lyssna)\b|^[\W_]*\d[\d.,]* ?k? ?(?:shares?|mal geteilt|partages?|veces compartido|partilhas|keer gedeeld|condivisioni|udostępnień|репост\w*|delningar)\W*$"
PROMPT = r"become a member|unlimited access|\bsubscribe\b|subscription|\bsign up\b|newsletter|morning briefing|your (?:e-?mail|inbox)|donat|(?:weeks|months) free|kostenlos testen|abonnier|e-mail-adresse|morgenbrief|melden sie sich|abonnez|s'abonner|adresse (?:électronique|e-?mail)|recevez chaque|suscr[ií]b|correo electrónico|reciba cada|bolet[ií]n|assine|endereço de e-?mail|abonneer|mailadres|abbonati|iscriviti|indirizzo e-?mail|subskryb|adres e-?mail|подпи(?:шитесь|ска)|электронн\w+ почт|prenumerera|e-postadress"
TEASER = r"^[\W_]*(?:read (?:also|more|next)|related|trending|most (?:read|popular)|you (?:may|might) also|more (?:from|on|stories)|recommended|editor'?s picks|latest (?:news|stories)|lesen sie auch|mehr (?:zum|aus|von)|meistgelesen|das könnte sie|auch interessant|à lire|sur le même sujet|les plus lus|vous aimerez|aussi sur|plus de|lea también|le puede interesar|lo más le[ií]do|(?:noticias|notas) relacionadas|más (?:de|sobre|noticias)|leia (?:também|mais)|mais lidas|lees ook|meest gelezen|meer (?:over|uit|van)|leggi anche|i più letti|potrebbe interessarti|czytaj (?:też|także|więcej)|najczęściej czytane|читайте также|самое читаемое|по теме|läs (?:också|även|mer)|mest läst)\b"
COMMENT = r"^[\W_]*(?:\d[\d.,]* (?:comments?|kommentare?|commentaires?|comentarios?|comentários?|reacties|commenti|komentarz\w*|комментари\w*|kommentarer)\W*$|(?:no )?comments?\W*$|join the (?:conversation|discussion)|log ?in to|leave a (?:comment|reply)|report a (?:problem|mistake)|anmelden und|kommentar(?:e| schreiben)|connectez-vous|réagir|inicie sesión|deje (?:un|su) comentario|inloggen om|accedi per|zaloguj się|войдите|logga in för)"
LEGAL = r"©|\(c\) \d{4}|^[\W_]*copyright \d|all rights reserved|(?:uses?|use of|using|accept|optional|necessary|all|set|store|this site'?s) cookies|cookies (?:and similar|to measure|to improve)|cookie (?:policy|settings|preferences|notice)|(?:einsatz|verwendung|nutzung) von cookies|(?:notwendige|alle|nutzt|verwendet) cookies|(?:dépôt|utilisation) de cookies|utilise des cookies|uso de cookies|(?:utiliza|usa|aceptar|solo) (?:las )?cookies|our \d+ partners|unsere \d+ partner|nuestros \d+ socios|privacy (?:policy|settings)|terms of (?:use|service)|· (?:privacy|imprint)|without (?:written|prior) permission|back to top|(?:change|withdraw) your (?:choices?|consent)|technologies are needed|auswahl können sie|diese technologien sind|modifier vos choix|ces technologies sont|cambiar (?:su|sus) \w+|estas tecnologías|manage preferences|accept all|reject (?:all|optional)|alle rechte vorbehalten|nachdruck nur|impressum|datenschutz|nach oben$|alle akzeptieren|einstellungen verwalten|tous droits réservés|mentions légales|reproduction (?:est )?interdite|haut de page|tout accepter|gérer mes préférences|continuer sans accepter|nos \d+ partenaires|todos los derechos|aviso legal|prohibida la reproducción|volver arriba|aceptar todo|configurar preferencias|todos os direitos|alle rechten voorbehouden|tutti i diritti|wszelkie prawa|все права|alla rättigheter"
_ADVERT, _SHARE, _PROMPT, _TEASER, _COMMENT, _LEGAL = (re.compile(p) for p in (ADVERT, SHARE, PROMPT, TEASER, COMMENT, LEGAL))
_HEADLINE = re.compile(r"^\W*\w+(?: \w+){1,3} (?:An?|The|Le|La|Les|L['’]|Un|Une|Der|Die|Das|Eine?|El|Los|Las|Una) ")
# A part of every wording of LEGAL and PROMPT; a text without any of them needs no closer look.
STEMS = (
    "©,(c) ,copyright,rights reserved,cookie,partner,partenaire,privacy,terms of,permission,back to top,preferences,accept all,reject all,reject optional,your choice,your consent,technologies,auswahl,technologien,"
    "vos choix,tecnolog,cambiar,rechte vorbehalten,nachdruck,impressum,datenschutz,nach oben,akzeptieren,einstellungen,droits réservés,mentions légales,reproduc,haut de page,tout accepter,gérer mes,continuer sans,"
    "derechos,aviso legal,volver arriba,aceptar,configurar,direitos,rechten voorbehouden,diritti,prawa,права,rättigheter,socios,become a member,unlimited access,subscri,sign up,mail,inbox,donat,weeks free,months free,"
    "kostenlos,abonn,morgenbrief,melden sie sich,adresse électronique,recevez chaque,suscr,correo electr,reciba cada,bolet,assine,abbonati,iscriviti,subskryb,подпи,электронн,prenumerera,postadress,newsletter,morning briefing"
).split(",")


_STEMS = ahocorasick.Automaton()
for _s in STEMS:
    _STEMS.add_word(_s, True)
_STEMS.make_automaton()


def _worded(low: str) -> bool:
    return next(_STEMS.iter(low), None) is not None


_WORD = re.compile(r"\w+")
_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*(?:\s+|$)")
_INVISIBLE = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]")
_MARK = re.compile(r"^(?:([•*\-–—·▪‣>»]+)|\(?(\d{1,3})[.)])\s+")
_TRAIL = re.compile(r"\s(?:[|·•»›>/]|::)\s|\s{3,}")


def plain(line: str) -> str:
    if line.isascii():
        return " ".join(line.split())
    return " ".join(_INVISIBLE.sub("", unicodedata.normalize("NFKC", line)).split())


def sentences(line: str) -> list[str]:
    out, at = [], 0
    for m in _END.finditer(line):
        if m.end() - at > 1:
            out.append(line[at : m.end()].strip())
            at = m.end()
    if line[at:].strip():
        out.append(line[at:].strip())
    return out


_NUMBER = re.compile(r"[$€£]?\d[\d.,]*")
_SIGNS = re.compile(r"[^\w§]+")
NAME = "\uf8ff"  # a private sign
POINTERS = (">>", "»", "→")
_MOST_WORDS = 200_000


class _Words(dict):
    """Words as they stand in a path: a sign for a capitalised one, else without marks, in lower case, numbers as 9."""

    def __init__(self, names: bool):
        super().__init__()
        self.names = names

    def __missing__(self, w: str) -> str:
        if len(self) >= _MOST_WORDS:
            self.clear()
        bare = w.lstrip("\"'“”«»‘’([¿¡")
        out = self[w] = NAME if self.names and bare[:1].isupper() else _SIGNS.sub(" ", _NUMBER.sub("9", w)).strip().casefold()
        return out


_FIRST, _LATER = _Words(False), _Words(True)


def path_text(text: str, site: str) -> str:
    """The generalised words of a line or sentence, its list mark first; the first word is never a name."""
    if site and site in text:
        text = text.replace(site, "§")
    m = _MARK.match(text)
    first, *rest = (text[m.end() :] if m else text).split(" ")
    out = " ".join(["*" if m and m[1] else "#" if m else "", _FIRST[first], *[_LATER[w] for w in rest]])
    while f"{NAME} {NAME}" in out:  # a name of several words is one
        out = out.replace(f"{NAME} {NAME}", NAME)
    return out


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) >> 4  # 60 bits: a zone fits beside it in a long


def path(text: str, site: str) -> int:
    """Hash of the generalised path of a line or sentence."""
    return _hash(path_text(text, site))


class Line:
    """What is known of one non-blank line by itself."""

    __slots__ = ("text", "low", "parts", "site", "kind", "count", "words", "trail", "mark", "n", "shape", "paths", "joint", "wording", "constant")

    def __init__(self, raw: str, site: str):
        self.text = plain(raw)
        self.low = self.text.casefold()
        self.parts = sentences(self.text)
        self.count = len(self.parts) if self.parts and _END.search(self.parts[-1]) else max(0, len(self.parts) - 1)
        self.words = self.text.count(" ") + 1 if len(self.text) > 200 else len(_WORD.findall(self.text))
        self.mark = bool(_MARK.match(self.text))
        self.n = max(1, len(self.parts))
        self.trail = bool(_TRAIL.search(raw.strip()))  # a menu or breadcrumb in one line
        self.site = site
        self.shape = self.count >= 2 or (len(self.text) >= 150 and self.count > 0)  # of a paragraph
        self.kind = self._kind(site)
        pointer = self.kind == "A" and self.n == 1 and not self.count and (self.text.startswith(POINTERS) or self.words > 7 and bool(_TEASER.search(self.low)))
        self.wording, self.constant = 0, False
        if self.n > 1:
            self.paths = [path(x, site) for x in self.parts]
        else:
            whole = path_text(self.text, site)
            self.paths = [0 if pointer else _hash(whole)]  # teasers within a text are known by their mark alone
            if not self.count:
                own = [w for w in whole[1:].split() if w != NAME]
                self.constant = len(own) >= 2 or "9" in own or self.kind in "FARC"
                self.wording = _hash(_SIGNS.sub(" ", _NUMBER.sub("9", self.low.replace(site.casefold(), "§") if site else self.low)))
        self.joint = hash(tuple(self.paths))

    def _kind(self, site: str) -> str:
        """F furniture, A notice, share line or prompt, R heading of teasers, C comments, P paragraph, S other."""
        low = self.low
        open_ended = not _END.search(self.text)
        if open_ended and (self.text.startswith(POINTERS) or (_TEASER.search(low) and self.words > 7)):
            return "A"  # a teaser within the text, heading and headline in one line
        if site and site.casefold() in low:
            return "A" if _PROMPT.search(low) and len(self.parts) == 1 else "F"
        if len(self.parts) <= 1 or self.words <= 14:
            if len(low) <= 110:
                if _COMMENT.search(low):
                    return "C"
                if _TEASER.search(low) and self.words <= 8 and not low.endswith((".", "!")):
                    return "R" if self.words <= 7 and not _HEADLINE.search(self.text) else "A"
                if _ADVERT.search(low) or _SHARE.search(low) or (_worded(low) and _PROMPT.search(low) and self.words <= 20):
                    return "A"
            if _worded(low) and _LEGAL.search(low):
                return "F"
        elif _worded(low):
            legal = sum(bool(_LEGAL.search(p.casefold()) or _PROMPT.search(p.casefold())) for p in self.parts)
            if legal >= 2 and legal * 2 >= len(self.parts):  # one such sentence may be an article's own
                return "F"
        return "P" if self.shape else "S"


_SEEN: dict[tuple[str, str], Line] = {}  # short lines come again and again on a host's pages
_MOST_SEEN = 50_000


def _line(raw: str, site: str) -> Line:
    if len(raw) > 120:
        return Line(raw, site)
    x = _SEEN.get((raw, site))
    if x is None:
        if len(_SEEN) >= _MOST_SEEN:
            _SEEN.clear()
        x = _SEEN[raw, site] = Line(raw, site)
    return x


def parse(content: str, site: str) -> list[Line | None]:
    return [_line(x, site) if x.strip() else None for x in content.split("\n")]


class Stored:
    """A line as the first walk left it: what the later ones need, without its text."""

    __slots__ = ("kind", "count", "words", "trail", "mark", "n", "shape", "constant", "paths", "joint", "wording")

    def __init__(self, kind: str, flags: int, n: int, paths: list[int], joint: int, wording: int):
        self.kind, self.n, self.paths, self.joint, self.wording = kind, n, paths, joint, wording
        self.count, self.words = flags & 1, 6 if flags & 4 else 4 if flags & 2 else 0
        self.trail, self.mark, self.shape, self.constant = flags & 8, flags & 16, flags & 32, flags & 64

    @property
    def sentence(self) -> bool:
        return bool(self.count) or self.n > 1 or bool(self.mark)


def title_line(lines: list[Line | None], title: str | None) -> int:
    """The first line that is the page's title; -1 if none is."""
    want = plain(title).casefold() if title else ""
    if want:
        for i, x in enumerate(lines):
            if x and x.low == want:
                return i
    return -1


class View:
    """A page's lines with what is known of standing notes and of paths so far."""

    def __init__(self, lines: list, title_at: int, standing: Callable, won: Callable, overruled: Callable, ends: Callable):
        self.lines, self.won = lines, {i for i, x in enumerate(lines) if x is not None and won(x)}
        # a wording of the lists counts until votes overrule it
        self.kinds = ["." if x is None else x.kind if x.kind not in "FARC" or not overruled(x) else "P" if x.shape else "S" for x in lines]
        self.standing = {i for i, x in enumerate(lines) if x is not None and x.shape and x.n > 1 and standing(x.joint)}
        self.gone = {i for i, k in enumerate(self.kinds) if k in "FA"} | self.won | self.standing
        self.ends = {i for i in self.gone if self.kinds[i] == "F" or i in self.standing or (self.kinds[i] != "A" and ends(lines[i]))}
        self.top = self._headline(title_at)
        if self.top is not None:
            n = len(lines)
            # teasers and comments come after an article: their headings bound it
            bound = next((i for i, k in enumerate(self.kinds) if i > self.top and k in "RC"), n)
            own = [i for i in range(self.top + 1, bound) if self.kinds[i] == "P" and lines[i].shape and i not in self.standing and not (i in self.won and lines[i].n == 1)]
            self.last = own[-1] if own else self.top
            self.first = next((i for i in range(self.top + 1, n) if lines[i] is not None and lines[i].count and i not in self.gone), self.last)
            self.end = next((i for i in range(self.last + 1, n) if self.kinds[i] in "RC" or i in self.ends), n)

    def _headline(self, title_at: int) -> int | None:
        """The line of the headline: the title if the page has it, else the first plain line that an article follows."""
        if title_at >= 0:
            return title_at
        seen = [i for i, x in enumerate(self.lines) if x is not None and self.kinds[i] in "PS" and i not in self.gone]
        stop = next((i for i, k in enumerate(self.kinds) if k in "RC"), len(self.lines))
        for at, i in enumerate(seen):
            x = self.lines[i]
            if i > stop:
                return None  # teasers and comments come after an article, if there is one
            if x.mark or x.trail or x.words < 4:
                continue
            after = [self.lines[j] for j in seen[at + 1 :]]
            if x.shape or any(y.shape for y in after) or sum(y.count > 0 and y.words >= 6 for y in after) >= 2:
                return i
        return None

    def zones(self) -> Iterator[tuple[Stored, int]]:
        for i, x in enumerate(self.lines):
            if x is None or i == self.top:
                continue
            if self.top is None:
                yield x, AFTER
            elif i < self.top:
                yield x, BEFORE
            elif i < self.first and not x.count and self.kinds[i] in "SA":
                yield x, HEAD
            else:  # what follows the last paragraph is the article's until a line gives the end away
                yield x, INSIDE if i <= self.last else AFTER

    def furniture(self) -> list[int]:
        """The numbers of the lines that aren't main body."""
        there = [i for i, x in enumerate(self.lines) if x is not None]
        if self.top is None:
            return there
        out = [i for i in there if i != self.top and (i < self.top or i >= self.end or i in self.gone)]
        none = set(out)
        if not any(self.lines[i].count and self.kinds[i] in "PS" for i in there if i > self.top and i not in none):
            return there  # a headline without a sentence after it isn't an article
        return out


def _never(x) -> bool:
    return False


WALKED = "host string, title_at int, kinds string, flags array<int>, sizes array<int>, paths array<long>, joints array<long>, wordings array<long>, standing array<struct<joint:long,title:long>>"


def _walk(keys: list[str], prior: bool):
    """The first walk over pages: each line's kind, flags and paths, and its paragraphs with the page's title."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for host, site, title, content in zip(b["host"], b["site"], b["title"], b["content"]):
                lines = parse(content, site or "")
                at = title_line(lines, title)
                there = [x for x in lines if x]
                flags = [(x.count > 0) | (x.words >= 4) << 1 | (x.words >= 6) << 2 | x.trail << 3 | x.mark << 4 | x.shape << 5 | x.constant << 6 for x in there]
                kinds = "".join("." if not x else x.kind if prior else "P" if x.shape else "S" for x in lines)
                # copies and numbered parts of an article have one generalised title; pages without one don't vote on notes
                name = path(plain(title), site or "") if title and title.strip() else None
                notes = [] if name is None else [{"joint": j, "title": name} for j in dict.fromkeys(x.joint for x in there if x.shape and x.n > 1)]
                rows.append((host, at, kinds, flags, [x.n for x in there], [p for x in there for p in x.paths], [x.joint for x in there], [x.wording for x in there], notes))
            out = pd.DataFrame(rows, columns=["host", "title_at", "kinds", "flags", "sizes", "paths", "joints", "wordings", "standing"], index=b.index)
            kept = [*keys, "content"] if "kept" in b else keys
            yield pd.concat([b[kept], out], axis=1)

    return run


def _stored(kinds: str, flags, sizes, paths, joints, wordings) -> list[Stored | None]:
    out, k, at = [], 0, 0
    flags, sizes, paths, joints, wordings = (x.tolist() for x in (flags, sizes, paths, joints, wordings))
    for c in kinds:
        if c == ".":
            out.append(None)
            continue
        n = sizes[k]
        out.append(Stored(c, flags[k], n, paths[at : at + n], joints[k], wordings[k]))
        k, at = k + 1, at + n
    return out


def _pages_of(b: pd.DataFrame) -> Iterator[list[Stored | None]]:
    for row in zip(b["kinds"], b["flags"], b["sizes"], b["paths"], b["joints"], b["wordings"]):
        yield _stored(*row)


def standing_notes(walked: DataFrame) -> DataFrame:
    """(host, key): paragraphs that recur under different titles, host null for those known on many hosts."""
    notes = materialise(walked.select("host", F.explode("standing").alias("s")).select("host", "s.joint", "s.title").distinct(), "titled")
    per = materialise(notes.groupBy("host", "joint").agg(F.count(F.lit(1)).alias("k")), "notes")
    sizes = walked.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    local = per.join(sizes, "host").where(F.col("k") >= F.greatest(F.lit(LEAST), STANDING_SHARE * F.col("pages"))).select("host", F.col("joint").alias("key"))
    hosts = sizes.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    # syndicated copies of one article have one title on many hosts
    titles = notes.select("joint", "title").distinct().groupBy("joint").agg(F.count(F.lit(1)).alias("titles")).where(F.col("titles") >= LEAST)
    many = per.groupBy("joint").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= max(LEAST, STANDING_HOSTS * hosts)).join(titles, "joint")
    return materialise(local.unionByName(many.select(F.lit(None).cast("string").alias("host"), F.col("joint").alias("key"))), "standing")


class Known:
    """Keys that hold on a host or everywhere (host null), for a Python walk: broadcast, or joined to each page's own keys."""

    def __init__(self, table: DataFrame, max_broadcast: int):
        self.table, self.sent = table, None
        if table.count() <= max_broadcast:
            by_host: dict = {}
            for r in table.toLocalIterator():  # at most max_broadcast rows
                by_host.setdefault(r["host"], set()).add(r["key"])
            self.sent = table.sparkSession.sparkContext.broadcast((by_host.pop(None, set()), by_host))

    def attach(self, pages: DataFrame, column: str, name: str) -> DataFrame:
        """pages with the keys of an array column that hold for them, where they aren't broadcast."""
        if self.sent is not None:
            return pages
        numbered = pages.withColumn("__row", F.xxhash64("host", "kinds", "paths", "title_at"))
        mine = numbered.select("__row", "host", F.explode(column).alias("key")).distinct()
        both = self.table.withColumnRenamed("host", "of")
        hits = mine.join(both, "key").where(F.col("of").isNull() | (F.col("of") == F.col("host"))).groupBy("__row").agg(F.collect_set("key").alias(name))
        return numbered.join(hits, "__row", "left").drop("__row")

    def reader(self, name: str) -> Callable:
        """A function from a batch to one test of keys for each page."""
        sent = self.sent

        def tests(b: pd.DataFrame) -> list[Callable]:
            if sent is None:
                return [set(x.tolist()).__contains__ if x is not None else _never for x in b[name]]
            everywhere, by_host = sent.value
            return [_either(everywhere, by_host.get(h, frozenset())) for h in b["host"]]

        return tests


def _either(a: set, b: set) -> Callable:
    return lambda k: k in a or k in b


def _zone_votes(standing: Callable):
    """A vote (path, zone, sentence or not, listed, wording) for each distinct path of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict = {}
            for host, at, note, lines in zip(b["host"], b["title_at"], standing(b), _pages_of(b)):
                view, seen = View(lines, at, note, _never, _never, _never), set()
                for x, zone in view.zones():
                    for p in x.paths:
                        if p and (p, zone) not in seen:
                            seen.add((p, zone))
                            listed = x.kind in "FARC"
                            k = (host, p)
                            v = out.get(k)
                            if v is None:
                                v = out[k] = [0, 0, 0, 0, 0, 0, x.wording, x.wording, x.constant > 0]
                            v[zone] += 1
                            v[4] |= x.sentence
                            v[5] |= listed
                            v[6], v[7] = min(v[6], x.wording), max(v[7], x.wording)
                            v[8] &= x.constant > 0
            rows = [(h, p, *v) for (h, p), v in out.items()]
            yield pd.DataFrame(rows, columns=["host", "path", "b", "i", "a", "h", "sentence", "listed", "w0", "w1", "constant"]).astype({"sentence": bool, "listed": bool, "constant": bool})

    return run


def consensus_paths(walked: DataFrame, standing: Known) -> tuple[DataFrame, DataFrame]:
    """(winners, overruled) as (host, key, ends) and (host, key), host null for what holds everywhere."""
    schema = "host string, path long, b long, i long, a long, h long, sentence boolean, listed boolean, w0 long, w1 long, constant boolean"
    pages = standing.attach(walked, "joints", "__notes")
    votes = pages.mapInPandas(_zone_votes(standing.reader("__notes")), schema)
    fold = [*[F.sum(c).alias(c) for c in "biah"], *[F.max(c).alias(c) for c in ("sentence", "listed", "w1")], F.min("w0").alias("w0"), F.min("constant").alias("constant")]
    by_host = materialise(votes.groupBy("host", "path").agg(*fold), "votes")
    everywhere = materialise(by_host.groupBy("path").agg(*fold, F.count(F.lit(1)).alias("hosts")), "votes_everywhere")
    sizes = walked.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # one wording for all of a path's lines: what stands in the head of pages everywhere alike is no author line
    fixed = F.col("constant") & (F.col("w0") == F.col("w1"))
    total, listed = F.col("b") + F.col("i") + F.col("a") + F.col("h"), F.col("listed").cast("int") * PRIOR
    outside = lambda alike: F.col("b") + F.col("a") + F.when(alike, F.col("h")).otherwise(0) + listed
    share = F.when(F.col("listed"), F.when(F.col("sentence"), PRIOR_OUTSIDE).otherwise(PRIOR_LINE)).otherwise(F.when(F.col("sentence"), OUTSIDE).otherwise(OUTSIDE_LINE))
    doubt = F.when(F.col("sentence") & ~F.col("listed"), DOUBT).otherwise(0)
    wins = lambda alike: outside(alike) >= share * (total + listed + doubt)
    ends = (F.col("a") + F.col("b") >= 0.7 * total) & (~F.col("sentence") | F.col("listed") | (F.col("b") >= 0.2 * total))
    far = everywhere.withColumn("won", wins(fixed)).withColumn("ends", ends)
    won = far.where("won and not listed").where(total >= LEAST).select(F.lit(None).cast("string").alias("host"), F.col("path").alias("key"), "ends")
    # on a host alone: paths that most hosts don't have, or that others have inside
    local = by_host.where(~F.col("listed")).join(sizes, "host").where(wins(F.lit(False)) & (total >= F.greatest(F.lit(LEAST), HOST_SHARE * F.col("pages"))))
    local = local.select("host", F.col("path").alias("key"), ends.alias("ends")).join(won.select("key"), "key", "left_anti").select("host", "key", "ends")
    over = far.where("listed and not won").select(F.lit(None).cast("string").alias("host"), F.col("path").alias("key"))
    return materialise(won.unionByName(local), "paths"), materialise(over, "overruled")


def _most(test: Callable) -> Callable:
    def won(x) -> bool:
        n, missed = x.n, 0
        for p in x.paths:  # more than half of the sentences, given up as soon as they can't be; of a paragraph all
            missed += not test(p)
            if missed * 2 >= n or (missed and x.shape and n > 1):
                return False
        return True

    return won


def _extracted(pages: DataFrame, keys: list[str], max_broadcast: int, prior: bool, schema: str, shape: Callable, text: bool = False) -> DataFrame:
    """The pages walked, voted on and walked again; shape makes the output of a batch and its furniture lines.

    Pages are parsed once: the first walk leaves kinds, flags and paths of their lines in a stage table, which the
    votes and the last walk read.
    """
    rows = pages.select(*keys, "host", "site", "title", "content").where(F.length(F.trim("content")) > 0)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    if text:
        rows = rows.withColumn("kept", F.lit(True))
    walked = materialise(rows.mapInPandas(_walk(keys, prior), f"{own}, {'content string, ' if text else ''}{WALKED}"), "walked")
    lines = walked.select("host", "title_at", "kinds", "flags", "sizes", "paths", "joints", "wordings")
    notes = Known(standing_notes(walked), max_broadcast)
    winners, over = consensus_paths(lines, notes)
    won, ends, overruled = Known(winners, max_broadcast), Known(winners.where("ends").select("host", "key"), max_broadcast), Known(over, max_broadcast)
    second = walked.drop("standing")
    for known, column, name in ((notes, "joints", "__notes"), (won, "paths", "__won"), (ends, "paths", "__ends"), (overruled, "paths", "__over")):
        second = known.attach(second, column, name)
    n, w, e, o = notes.reader("__notes"), won.reader("__won"), ends.reader("__ends"), overruled.reader("__over")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for lines, at, note, a, c, d in zip(_pages_of(b), b["title_at"], n(b), w(b), e(b), o(b)):
                unlisted = _most(a)
                got.append(View(lines, at, note, lambda x, t=unlisted: x.kind not in "FARC" and t(x), lambda x, t=_most(d): t(x), lambda x, t=c: any(map(t, x.paths))).furniture())
            yield shape(b, got)

    return second.mapInPandas(run, f"{own}, {schema}")


def furniture_lines(pages: DataFrame, keys: list[str], max_broadcast: int = MAX_BROADCAST, prior: bool = True) -> DataFrame:
    """(keys..., line_no) for each line that isn't main body; pages: keys, host, site (its name), title, content."""

    def shape(b: pd.DataFrame, lines: list[list[int]]) -> pd.DataFrame:
        return b[keys].assign(line_no=lines).explode("line_no").dropna(subset=["line_no"]).astype({"line_no": "int64"})

    return _extracted(pages, keys, max_broadcast, prior, "line_no long", shape).distinct()


def main_body(pages: DataFrame, keys: list[str], max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(keys..., body): the lines of each page's article, joined by line breaks; null where there is none.

    The last walk writes the bodies; no page is taken apart and put together in a shuffle.  Pages with one key and
    different contents have a row each.
    """

    def shape(b: pd.DataFrame, lines: list[list[int]]) -> pd.DataFrame:
        bodies = []
        for content, gone in zip(b["content"], map(set, lines)):
            kept = [x.rstrip() for i, x in enumerate(content.split("\n")) if i not in gone and x.strip()]
            bodies.append("\n".join(kept) if kept else None)
        return b[keys].assign(body=bodies)

    empty = pages.where(F.coalesce(F.length(F.trim("content")), F.lit(0)) == 0).select(*keys, F.lit(None).cast("string").alias("body"))
    return _extracted(pages, keys, max_broadcast, True, "body string", shape, text=True).unionByName(empty).distinct()
