"""One parser for dates and times in mixed notations.

``parse_instant(raw, zone, order)`` gives ``YYYY-MM-DDTHH:MM:SS.ffffffZ`` for a time, ``YYYY-MM-DD`` for a date
without time of day, and None for all else (durations, words, blanks, impossible dates).

Defined cases: finer digits than microseconds are cut off; an interval counts as its start; a month or year as
its first day; 24:00 is 00:00 of the next day; a wall time without a zone of its own is in ``zone`` (null or
unknown: UTC); a repeated wall time is its first occurrence, a skipped one moves forward by the gap; a zone
abbreviation is that of ``zone`` where the zone has it, else its common meaning; dates with slashes follow
``order`` (mdy, else dmy); two-digit years are of this century.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

UTC = timezone.utc
# Month names and common short forms of the ten languages, without accents, in lower case.
MONTHS: dict[str, int] = {}
for _line in (
    "january jan|february feb|march mar|april apr|may|june jun|july jul|august aug|september sep sept|october oct|november nov|december dec",
    "januar jaenner|februar|marz maerz mrz|april|mai|juni|juli|august|september|oktober okt|november|dezember dez",
    "janvier janv|fevrier fevr fev|mars|avril avr|mai|juin|juillet juil|aout|septembre|octobre|novembre|decembre",
    "enero ene|febrero|marzo|abril abr|mayo|junio|julio|agosto ago|septiembre setiembre set|octubre|noviembre|diciembre dic",
    "janeiro|fevereiro|marco|abril|maio|junho|julho|agosto|setembro|outubro out|novembro|dezembro",
    "gennaio gen|febbraio|marzo|aprile|maggio mag|giugno giu|luglio lug|agosto|settembre|ottobre ott|novembre|dicembre",
    "januari|februari|maart mrt|april|mei|juni|juli|augustus|september|oktober|november|december",
    "stycznia styczen|lutego luty|marca marzec|kwietnia kwiecien|maja maj|czerwca czerwiec|lipca lipiec|sierpnia sierpien|wrzesnia wrzesien|pazdziernika pazdziernik|listopada listopad|grudnia grudzien",
    "января январь|февраля февраль|марта март|апреля апрель|мая маи|июня июнь|июля июль|августа август|сентября сентябрь|октября октябрь|ноября ноябрь|декабря декабрь",
    "januari|februari|mars|april|maj|juni|juli|augusti|september|oktober|november|december",
):
    for _i, _names in enumerate(_line.split("|")):
        for _n in _names.split():
            MONTHS.setdefault(_n, _i + 1)
# Zone abbreviations that the zone database writes as digits, or that a zone may not know, in minutes.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "west": 60, "bst": 60, "ist": 330, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "brt": -180, "brst": -120, "art": -180, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "jst": 540, "kst": 540, "hkt": 480, "sgt": 480,
}

_DATE = r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})"
_WEEK = r"(?P<wy>\d{4})-?W(?P<w>\d{2})(?:-?(?P<wd>[1-7]))?"
_BASIC = r"(?P<by>\d{4})(?P<bm>\d{2})(?P<bd>\d{2})"
_CLOCK = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?"
_ZONE = r"(?P<zone>[Zz]|(?:UTC|GMT)?\s?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5})?(?P<region>\[[\w/+\-]+\])?"
_AMPM = r"(?:\s?(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ISO = re.compile(rf"(?:{_DATE}|{_WEEK}|{_BASIC})(?:(?:[Tt]|\s+)(?:{_CLOCK}|(?P<bH>\d{{2}})(?P<bM>\d{{2}})(?:(?P<bS>\d{{2}})(?:[.,](?P<bf>\d+))?)?)\s*{_ZONE})?")
_NUMERIC = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[/.-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK}{_AMPM}(?:\s?Uhr)?\s*{_ZONE})?")
_DAY = r"(?:(?P<dow>[^\W\d]{2,12})\.?,?\s+)?"
_NAMED = re.compile(
    rf"{_DAY}(?:(?P<d1>\d{{1,2}})(?:st|nd|rd|th|er|\.|º|ª)?\s+(?:de\s+|of\s+)?(?P<n1>[^\W\d]{{3,12}})\.?,?\s+(?:de\s+|del\s+)?(?P<y1>\d{{4}})(?:\s*г\.?)?"
    rf"|(?P<n2>[^\W\d]{{3,12}})\.?\s+(?P<d2>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y2>\d{{4}}))(?:,?\s+(?:at\s+|um\s+)?{_CLOCK}{_AMPM}(?:\s?Uhr)?\s*{_ZONE})?"
)
_NAMED_MONTH = re.compile(r"(?P<n>[^\W\d]{3,12})\.?,?\s+(?:de\s+)?(?P<y>\d{4})")
_EPOCH = re.compile(r"(\d{10}|\d{13}|\d{16}|\d{19})(?:\.(\d+))?")


def plain(s: str) -> str:
    """Without accents, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


@lru_cache(512)
def _zone(name: str | None) -> ZoneInfo | timezone:
    try:
        return ZoneInfo(name) if name else UTC
    except (KeyError, ValueError, OSError):
        return UTC


@lru_cache(4096)
def _abbreviation(abbr: str, zone: str | None) -> timezone | None:
    """The offset of an abbreviation in a zone, from its two times of year; else its common meaning."""
    z = _zone(zone)
    for month in (1, 7):
        at = datetime(2023, month, 1, tzinfo=z)
        if (at.tzname() or "").lower() == abbr:
            return timezone(at.utcoffset())
    minutes = ABBREVIATIONS.get(abbr)
    return None if minutes is None else timezone(timedelta(minutes=minutes))


def _offset(text: str) -> timezone | None:
    m = re.fullmatch(r"(?:UTC|GMT)?\s?([+-])(\d{1,2})(?::?(\d{2}))?", text)
    if not m or int(m[2]) > 15 or int(m[3] or 0) > 59:
        return None
    minutes = int(m[2]) * 60 + int(m[3] or 0)
    return timezone(timedelta(minutes=-minutes if m[1] == "-" else minutes))


def _instant(day: date, g: dict, zone: str | None) -> str | None:
    """A date with the clock and zone groups of a match."""
    hour, minute, second = int(g["H"]), int(g["M"]), int(g["S"] or 0)
    if ap := g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if ap in "Pp" else 0)
    micro = int(((g["f"] or "") + "000000")[:6])
    extra = timedelta(0)
    if hour == 24 and minute == second == micro == 0:
        hour, extra = 0, timedelta(days=1)
    elif second == 60 and hour < 24 and minute < 60:  # a leap second
        second, extra = 59, timedelta(seconds=1)
    at = datetime(day.year, day.month, day.day, hour, minute, second, micro) + extra
    tz, said = None, g["zone"]
    if said:
        low = said.lower()
        if low == "z":
            tz = UTC
        elif said[-1].isdigit():
            tz = _offset(said.upper())
        else:
            tz = _abbreviation(low, zone)
        if tz is None:
            return None
    elif g.get("region"):
        tz = _zone(g["region"][1:-1])
    if tz is None:
        tz = _zone(zone)
    out = at.replace(tzinfo=tz, fold=0).astimezone(UTC)
    return out.strftime("%Y-%m-%dT%H:%M:%S.") + f"{out.microsecond:06d}Z"


def _parse(s: str, zone: str | None, order: str | None) -> str | None:
    if m := _ISO.fullmatch(s):
        g = m.groupdict()
        if g["y"]:
            day = date(int(g["y"]), int(g["m"]), int(g["d"]))
        elif g["wy"]:
            day = date.fromisocalendar(int(g["wy"]), int(g["w"]), int(g["wd"] or 1))
        else:
            day = date(int(g["by"]), int(g["bm"]), int(g["bd"]))
        if g["bH"]:
            g |= {"H": g["bH"], "M": g["bM"], "S": g["bS"], "f": g["bf"]}
        return _instant(day, g, zone) if g["H"] else day.isoformat()
    if m := _EPOCH.fullmatch(s):
        n = int(m[1])
        micros = {10: n * 1_000_000 + int(((m[2] or "") + "000000")[:6]), 13: n * 1000, 16: n, 19: n // 1000}[len(m[1])]
        out = datetime(1970, 1, 1) + timedelta(microseconds=micros)
        return out.strftime("%Y-%m-%dT%H:%M:%S.") + f"{out.microsecond:06d}Z"
    if m := _NUMERIC.fullmatch(s):
        g = m.groupdict()
        a, b, y = int(g["a"]), int(g["b"]), int(g["y"])
        if g["sep"] == "/" and order == "mdy":
            a, b = b, a
        day = date(y + 2000 if y < 100 else y, b, a)
        return _instant(day, g, zone) if g["H"] else day.isoformat()
    if m := _NAMED.fullmatch(s):
        g = m.groupdict()
        month = MONTHS.get(plain(g["n1"] or g["n2"]))
        if not month:
            return None
        day = date(int(g["y1"] or g["y2"]), month, int(g["d1"] or g["d2"]))
        return _instant(day, g, zone) if g["H"] else day.isoformat()
    if re.fullmatch(r"\d{4}", s):
        return date(int(s), 1, 1).isoformat()
    if m := re.fullmatch(r"(\d{4})[-/](\d{1,2})", s):
        return date(int(m[1]), int(m[2]), 1).isoformat()
    if m := re.fullmatch(r"(\d{4})/(\d{1,2})/(\d{1,2})", s):
        return date(int(m[1]), int(m[2]), int(m[3])).isoformat()
    if m := re.fullmatch(r"(\d{4})-?Q([1-4])", s):
        return date(int(m[1]), int(m[2]) * 3 - 2, 1).isoformat()
    if (m := _NAMED_MONTH.fullmatch(s)) and (month := MONTHS.get(plain(m["n"]))):
        return date(int(m["y"]), month, 1).isoformat()
    return None


LONGEST = 80
_LONG_FRACTION = re.compile(r"([^.,]*[.,]\d{6})\d+(\D.*)?")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")


def parse_instant(raw: str | None, zone: str | None = None, order: str | None = None) -> str | None:
    if not isinstance(raw, str):
        return None
    s = " ".join(_INVISIBLE.sub("", unicodedata.normalize("NFKC", raw)).replace("−", "-").split())
    if not s or not any(c.isdigit() for c in s):
        return None
    if len(s) > LONGEST and (m := _LONG_FRACTION.fullmatch(s)):
        s = m[1] + m[2]  # digits beyond microseconds are cut off, however many
    try:
        found = _parse(s, zone, order)
        if found is None:
            for mark in ("/", " - ", " – ", "--"):  # an interval: its start
                head, sep, _ = s.partition(mark)
                if sep and len(head) >= 4 and head[:4].isdigit() and (found := _parse(head.strip(), zone, order)):
                    break
        return found
    except (ValueError, OverflowError):
        return None
