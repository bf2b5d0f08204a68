"""Column expressions: everything here stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
PUNCTUATION = r"[!-/:-@\[-`{-~]"
# The words that keyword extraction leaves out; results depend on exactly these.
STOP_WORDS = (
    "that this with from have will been were said would could their about which there where when what who whom whose they them these "
    "those then than such into through during before after above below between under again further once here more most other some only "
    "very also just should being both each much many same over because however therefore thus"
).split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rows() -> Column:
    """The number of rows."""
    return F.count(F.lit(1))


# -- time ---------------------------------------------------------------------------------------------------------


def interval_start(c: Column | str) -> Column:
    """The start of an ISO interval, or the value itself."""
    return F.split(col(c), "/")[0]


def iso_date(c: Column | str) -> Column:
    """The date of an ISO value (an interval's start); null for all else, impossible dates included."""
    s = interval_start(c)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ])"), F.substring(s, 1, 10).try_cast("date"))


def iso_timestamp(c: Column | str) -> Column:
    """The instant of an ISO value with seconds, without zone or in UTC; a date is its midnight; else null."""
    s = F.regexp_replace(interval_start(c), r"(?i)z$", "")
    ok = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?)?$")
    return F.when(ok, F.regexp_replace(s, "T", " ").try_cast("timestamp_ntz"))


def is_iso8601(c: Column | str) -> Column:
    """Date, date and time, interval or duration in ISO form."""
    return col(c).rlike(r"^\d{4}-\d{2}-\d{2}($|T\d{2}:\d{2}|/)|^P(\d+[YMWD])*(T(\d+[HMS])+)?$")


def time_parts(c: Column | str) -> list[Column]:
    d = iso_date(c)
    return [F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month")]


WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
# Days a relative phrase lies from the document's date.
RELATIVE = {"today": 0, "yesterday": -1, "tomorrow": 1, "last week": -7, "next week": 7, "last month": -30, "next month": 30}


def resolve_relative(text: Column | str, anchor: Column | str) -> Column:
    """A phrase as a date: ISO as it is, a weekday as its latest past occurrence, a relative phrase from the anchor; else null."""
    t, d = F.lower(F.trim(col(text))), col(anchor)
    out = F.when(is_iso8601(F.trim(col(text))), F.trim(col(text)))
    for i, name in enumerate(WEEKDAYS):
        out = out.when(t.rlike(rf"\b{name}\b"), F.date_format(F.date_sub(d, F.pmod(F.weekday(d) - i, F.lit(7))), "yyyy-MM-dd"))
    for phrase, days in RELATIVE.items():
        out = out.when(t.rlike(rf"\b{phrase}\b"), F.date_format(F.date_add(d, days), "yyyy-MM-dd"))
    return out


# -- space --------------------------------------------------------------------------------------------------------


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Kilometres on a sphere."""
    a1, o1, a2, o2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a1, o1, a2, o2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    y, x = F.sin(o2 - o1) * F.cos(a2), F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(o2 - o1)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def direction(degrees: Column | str) -> Column:
    """The nearest of eight directions."""
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.pmod(F.bround(col(degrees) / 45, 0).cast("int"), F.lit(8)) + 1).cast("int"))


def located(lat="latitude", lon="longitude") -> Column:
    """Whether both coordinates are there, in range, and not both 0."""
    a, o = col(lat), col(lon)
    return F.coalesce(a.between(-90, 90) & o.between(-180, 180) & ~((a == 0) & (o == 0)), F.lit(False))


# -- text ---------------------------------------------------------------------------------------------------------


def normalise_answer(c: Column | str) -> Column:
    """Lower case, without ASCII punctuation and articles, single blanks."""
    s = F.regexp_replace(F.regexp_replace(F.lower(col(c)), PUNCTUATION, ""), r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def answer_tokens(c: Column | str) -> Column:
    return F.filter(F.split(normalise_answer(c), " "), lambda x: x != "")


def token_overlap(p: Column, g: Column) -> Column:
    """Size of the intersection of two token multisets."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_distinct(p), F.lit(0), lambda a, t: a + F.least(count(p, t), count(g, t)))


def token_f1(pred: Column | str, gold: Column | str) -> Column:
    """struct(precision, recall, f1); both empty: 1, one empty: 0."""
    p, g = answer_tokens(pred), answer_tokens(gold)
    n, both, none = token_overlap(p, g).cast("double"), (F.size(p) == 0) & (F.size(g) == 0), (F.size(p) == 0) | (F.size(g) == 0)
    rule = lambda x: F.when(both, 1.0).when(none | (n == 0), 0.0).otherwise(x)
    return F.struct(rule(F.try_divide(n, F.size(p))).alias("precision"), rule(F.try_divide(n, F.size(g))).alias("recall"), rule(F.try_divide(2 * n, F.size(p) + F.size(g))).alias("f1"))


def answer_coverage(answer: Column | str, context: Column | str) -> Column:
    """Share of the answer's distinct tokens in the context; 1 for an empty answer."""
    a, c = F.array_distinct(answer_tokens(answer)), answer_tokens(context)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, c)) / F.size(a))


def preview(c: Column | str, sentences: int = 2, limit: int = 200) -> Column:
    """The first sentences, cut at a word at the limit."""
    s = F.trim(col(c))
    head = F.array_join(F.slice(F.split(s, r"[.!?]+\s+"), 1, sentences), ". ")
    head = F.when(head.rlike(r"[.!?]$"), head).otherwise(F.concat(head, F.lit(".")))
    return F.when(F.char_length(head) <= limit, head).otherwise(F.concat(F.regexp_replace(F.substring(head, 1, limit), r"\s+\S*$", ""), F.lit("...")))


def words(c: Column | str) -> Column:
    """Lower-case words of four or more letters, all of them ASCII."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}]+"), lambda x: x.rlike("^[a-z]{4,}$"))


def snake(c: Column | str) -> Column:
    """A dimension's name in its normal form."""
    return F.replace(F.lower(F.trim(col(c))), F.lit(" "), F.lit("_"))


def hierarchy_path(levels: Column | str) -> Column:
    return F.array_join(F.transform(col(levels), lambda x: F.lower(F.trim(x))), " > ")


def table_rows(c: Column | str) -> Column:
    """array<array<string>>: lines by cells, blanks dropped."""
    cells = lambda line: F.filter(F.transform(F.split(line, r"\t|\s\|\s"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(F.transform(F.split(col(c), "\n"), cells), lambda r: F.size(r) > 0)


def content_id(c: Column | str) -> Column:
    return F.substring(F.md5(col(c)), 1, 12)


# -- queries ------------------------------------------------------------------------------------------------------


def clean_query(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(col(c), r"\s+", " ")), r"\?+$", "")


def temporal_hints(c: Column | str) -> Column:
    q = col(c)
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    found = [F.regexp_extract_all(q, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), F.regexp_extract_all(q, F.lit(rf"(?i)\b({months})\b"), F.lit(1)), F.regexp_extract_all(q, F.lit(r"\b(Q[1-4])\b"), F.lit(1))]
    return F.array_distinct(F.flatten(F.array(*found)))


def spatial_hints(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"\b(?:in|at|near|from) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1)))


def query_kind(c: Column | str) -> Column:
    q = F.lower(col(c))
    return (
        F.when(q.rlike(r"\b(that|who|which) (?:was|were|is|are|has|had)\b"), "multihop").when(q.rlike(r"\b(compare|difference|versus|vs)\b"), "comparison")
        .when(q.rlike(r"\bwhen\b") | (F.size(temporal_hints(c)) > 0), "temporal").when(q.rlike(r"\bwhere\b") | (F.size(spatial_hints(c)) > 0), "spatial").otherwise("simple")
    )
