"""Places in free text: cities of venues, regions after a comma, search queries, matching of predicted places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesseral.functions.columns import col, haversine

# Words of a venue's kind that follow its city.
VENUES = "international airport|airport|stadium|arena|hospital|university|convention cent(?:er|re)|cent(?:er|re)|museum|station|park|hall|college|port"
# Tag keys of a map feature in the order that decides its kind; results depend on exactly these.
FEATURE_KEYS = ("place", "natural", "waterway", "landuse", "amenity", "tourism", "building", "highway", "railway")


def city_of_venue(c: Column | str) -> Column:
    """The city in a venue's name: kind words and a possessive dropped, the part before a comma or dash; null if nothing is left."""
    s = F.split(F.regexp_replace(col(c), r"['’]s\b", ""), r",|\s[-–]\s")[0]
    s = F.trim(F.regexp_replace(F.regexp_replace(s, rf"(?i)\b(?:{VENUES})\b.*$", ""), r"\s+", " "))
    return F.when(s != "", s)


def region_in_context(c: Column | str) -> Column:
    """The last capitalised words after a comma, else the last ones after in, at, near or from; null if there are none."""
    after = F.regexp_extract_all(col(c), F.lit(r",\s+([A-Z]\w+(?:\s[A-Z]\w+)*)"), F.lit(1))
    within = F.regexp_extract_all(col(c), F.lit(r"\b(?:in|at|near|from)\s+([A-Z]\w+(?:\s[A-Z]\w+)*)"), F.lit(1))
    return F.coalesce(F.try_element_at(after, F.lit(-1)), F.try_element_at(within, F.lit(-1)))


def search_query(place: Column | str, region: Column | str) -> Column:
    """Place and region, unless the place names the region already."""
    p, r = col(place), col(region)
    return F.when(r.isNull() | F.contains(F.lower(p), F.lower(r)), p).otherwise(F.concat_ws(", ", p, r))


def feature_kind(tags: Column | str) -> Column:
    return F.coalesce(*[F.try_element_at(col(tags), F.lit(k)) for k in FEATURE_KEYS], F.lit("feature"))


def cache_key(lat: Column | str, lon: Column | str, km: Column | float) -> Column:
    return F.concat_ws("_", F.format_string("%.4f", col(lat)), F.format_string("%.4f", col(lon)), (km if isinstance(km, Column) else F.lit(km)).cast("string"))


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda x: x != ""))


def word_overlap(a: Column | str, b: Column | str) -> Column:
    """Jaccard of the words of two texts; 0 where both are empty."""
    x, y = _words(col(a)), _words(col(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def same_place(predicted: Column | str, truth: Column | str, least: float = 0.5) -> Column:
    """Equal, one within the other, or half of the words shared; case aside; an empty text matches an empty one only."""
    p, t = F.lower(F.trim(col(predicted))), F.lower(F.trim(col(truth)))
    return F.when((p == "") | (t == ""), p == t).otherwise((p == t) | F.contains(p, t) | F.contains(t, p) | (word_overlap(p, t) >= least))


def same_time(predicted: Column | str, truth: Column | str) -> Column:
    """Equal values, midnight, a trailing zone and fractions aside."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(col(c), r"(?:Z|[+-]\d{2}:?\d{2})$", ""), r"\.\d+$", ""), r"T00:00(?::00)?$", "")
    return plain(predicted) == plain(truth)


def mean_distance(lat: Column | str, lon: Column | str, points: Column | str) -> Column:
    """Mean kilometres to points array<struct<latitude, longitude>>; null without points."""
    d = F.transform(col(points), lambda p: haversine(lat, lon, p["latitude"], p["longitude"]))
    return F.try_divide(F.aggregate(d, F.lit(0.0), lambda a, x: a + x), F.size(col(points)))
