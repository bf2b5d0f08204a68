"""Questions read for what they ask: names in them, parts of two-step questions, filters they suggest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesseral.functions.columns import col, spatial_hints, temporal_hints


def entities(c: Column | str) -> Column:
    """The distinct capitalised words of a question behind its first word, signs dropped, sorted."""
    words = F.split(F.trim(F.regexp_replace(col(c), r"\s+", " ")), " ")
    clean = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.regexp_replace(w, r"[^0-9A-Za-z_\p{L}\p{N}]", ""))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda w: w.rlike(r"^\p{Lu}"))))


def sub_questions(c: Column | str) -> Column:
    """A question of the form "the X that Y" as two, what meets the condition asked first; any other alone."""
    q, form = col(c), r"(?i)\bthe\s+(\w+(?:\s+\w+)*)\s+that\s+([^?]+)"
    kind, rule = F.regexp_extract(q, form, 1), F.trim(F.regexp_extract(q, form, 2))
    return F.when(kind != "", F.array(F.concat(F.lit("What "), kind, F.lit(" "), rule, F.lit("?")), q)).otherwise(F.array(q))


def suggested_year(c: Column | str) -> Column:
    """The first year or quarter among a question's hints, if it is a year."""
    first = F.try_element_at(_periods(c), F.lit(1))
    return F.when(first.rlike(r"^\d{4}$"), first.cast("int"))


def suggested_quarter(c: Column | str) -> Column:
    first = F.try_element_at(_periods(c), F.lit(1))
    return F.when(first.rlike(r"(?i)^Q[1-4]$"), F.substring(first, 2, 1).cast("int"))


def _periods(c: Column | str) -> Column:
    return F.filter(temporal_hints(c), lambda x: x.rlike(r"(?i)^(?:(?:19|20)\d{2}|Q[1-4])$"))


def suggested_region(c: Column | str) -> Column:
    return F.try_element_at(spatial_hints(c), F.lit(1))


def yes_no_kind(code: Column | str) -> Column:
    """The kind of a question that carries its own yes-or-no code (1: yes or no)."""
    return F.when(col(code) == 1, "yes_no").otherwise("undefined")


def ascii_text(c: Column | str) -> Column:
    """Compatibility form without accents and without what ASCII lacks."""

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")

    return plain(col(c))


def clock_24(hour: Column, minute: Column, period: Column) -> Column:
    """HH:MM of a clock of twelve hours; without am or pm the hour as it stands."""
    h = F.when((period == "pm") & (hour != 12), hour + 12).when((period == "am") & (hour == 12), 0).otherwise(hour)
    return F.format_string("%02d:%02d", h, minute)


def time_range(c: Column | str) -> Column:
    """struct(start, end) of a range of clock times with am or pm on either side; null if there is none.

    Two bare numbers are no range: one side needs am or pm, or both need minutes.
    """
    t = F.lower(col(c))
    form = r"(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s*(?:to|-|–|until)\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)?(?:[^\d:]|$)"
    g = [F.regexp_extract(t, form, i) for i in range(1, 7)]
    num = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    sure = (g[2] != "") | (g[5] != "") | ((g[1] != "") & (g[4] != ""))
    fits = (num(g[0]) < 24) & (num(g[3]) < 24) & (num(g[1]) < 60) & (num(g[4]) < 60)
    return F.when((g[0] != "") & sure & fits, F.struct(clock_24(num(g[0]), num(g[1]), g[2]).alias("start"), clock_24(num(g[3]), num(g[4]), g[5]).alias("end")))
