"""Mapping freely typed values to the closest entry of a reference list (problem 3).

Method: distinct values are normalised (case, accents, invisible signs, look-alike digits, list marks, prefixes
such as "type=", remarks in brackets or after a dash); character n-grams of the values meet an inverted index of
the n-grams of all entry names and aliases of the same group; candidates are scored by weighted (idf) cosine, and
the best is accepted above a threshold and a margin to the second entry.  An exact check follows on the candidates
of each value: edit distance with swaps on the letters in any word order, and abbreviation of each word, which
settle what n-grams of short words cannot.  The result joins back to the rows by the raw value.

Defined results: null and blank values have no row; ties between entries, and values fitting none, are 0; groups
without entries give 0; repeated rows are mapped alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.functions.strings import abbreviates, fold, osa, unleet
from tesseral.operators.lookup import join_back
from tesseral.session import materialise

THRESHOLD = 0.70  # similarity of an accepted entry
MARGIN = 0.08  # by which it leads the next entry
RECALL = 0.20  # cosine from which an entry is a candidate
# Words that say nothing of the value.
FILLERS = frozenset("of the a an and other severe type cat category kind value label".split())
_PREFIX = re.compile(r"^\s*(?:[\w ]{1,12}[:=]|#+|\(?\d{1,3}[.)]|[-*•])\s*")
_REMARK = re.compile(r"\s*(?:\([^()]*\)|\[[^\[\]]*\])\s*$|\s+[-–—]\s+\w+(?:\s\w+)?\s*$")


def words(value: str | None) -> list[str]:
    """The normalised words of a typed value."""
    if not value:
        return []
    s = fold(value)
    s = _PREFIX.sub("", s) or s
    s = _REMARK.sub("", s) or s
    found = [unleet(w) for w in re.findall(r"[^\W_]+", s)]
    if len(found) == 2 and len(found[1]) == 1 and found[0].endswith(tuple("0123456789")):
        found = [found[0].rstrip("0123456789"), found[1]]
    return [w for w in found if w not in FILLERS or (len(w) == 1 and len(found) > 1)] or found


def grams(ws: list[str]) -> list[str]:
    """2- and 3-grams of each word with its ends marked, pairs of letters with one between them, and the same of the
    words run together, and each word's letters in order of the alphabet; no order of words.  The pairs keep a mistyped
    letter, the ordered letters a swap, within reach of short words."""
    out = set()
    for w in [*ws, "".join(ws)] if len(ws) > 1 else ws:
        p = f"^{w}$"
        out.update(p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1))
        out.update(f"~{p[i]}{p[i + 2]}" for i in range(len(p) - 2))
        out.add("=" + "".join(sorted(w)))
    return sorted(out)


def _arranged(ws: list[str]) -> list[str]:
    """The letters of the words in the orders worth comparing: as typed, and reordered by rotation."""
    return ["".join(ws[i:] + ws[:i]) for i in range(len(ws))] or [""]


def similarity(value: list[str], entry: list[str], cosine: float) -> float:
    """1 for the same letters, else by edits, or as an abbreviation of each word, or the cosine."""
    a, b = value, "".join(entry)
    if not a:
        return 0.0
    best = 0.0
    for s in _arranged(a):
        n = max(len(s), len(b))
        most = max(1, n // 3)
        d = osa(s, b, most)
        if d <= most:
            best = max(best, 1 - d / n)
    if len(a) == len(entry) and any(len(w) >= 3 for w in a):
        fits = [1.0 if x == y else 0.95 if abbreviates(x, y) and (len(x) >= 3 or len(entry) > 1) else 0.0 for x, y in zip(a, entry)]
        if all(fits):
            best = max(best, sum(fits) / len(fits) - 0.05)
    # n-grams alone must cover the value well
    return max(best, cosine * 0.9)


def _prepare(df: DataFrame, column: str, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["words"] = [words(x) for x in b[column]]
            b["gram"] = [grams(w) for w in b["words"]]
            yield b

    return df.mapInPandas(run, f"{schema}, words array<string>, gram array<string>")


def match_values(values: DataFrame, entries: DataFrame, recall: float | None = None) -> DataFrame:
    """(grp, value, entry_id, score) for distinct (grp, value): the entry of the group meant, or 0.

    entries: (grp, entry_id, name), one row for each name or alias.  No candidate is capped: every entry that
    shares enough n-gram weight is scored.
    """
    least = RECALL if recall is None else recall
    typed = materialise(_prepare(values.select("grp", "value").where("value is not null").distinct(), "value", "grp string, value string"), "typed")
    known = _prepare(entries.select("grp", "entry_id", "name").distinct(), "name", "grp string, entry_id long, name string")
    per_entry = materialise(known.select("grp", "entry_id", "name", F.col("words").alias("entry_words"), F.explode("gram").alias("g")), "entries")
    groups = per_entry.select("grp", "entry_id", "name").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("names"))
    idf = per_entry.groupBy("grp", "g").agg(F.count(F.lit(1)).alias("df")).join(groups, "grp").select("grp", "g", F.log1p(F.col("names") / F.col("df")).alias("w"))
    index = per_entry.join(idf, ["grp", "g"])
    norms = index.groupBy("grp", "entry_id", "name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("entry_norm"))
    index = materialise(index.join(norms, ["grp", "entry_id", "name"]), "index")
    # grams that no entry has count in the value's norm with the weight of a gram of one entry
    side = typed.select("grp", "value", F.explode("gram").alias("g")).join(idf, ["grp", "g"], "left").join(groups, "grp")
    side = side.withColumn("known", F.col("w").isNotNull()).withColumn("w", F.coalesce("w", F.log1p("names")))
    of = side.groupBy("grp", "value").agg(F.sum(F.col("w") * F.col("w")).alias("sq"), F.array_sort(F.collect_list(F.when(F.col("known"), F.struct((-F.col("w")).alias("r"), "g")))).alias("gs"))
    # prefix filter: the rarest grams of a value are looked up until the rest could no longer reach RECALL, since a
    # cosine from the rest alone is at most the rest's share of the value's norm
    rest = lambda gs, i: F.aggregate(F.slice(gs, i + 1, F.size(gs)), F.lit(0.0), lambda t, x: t + x["r"] * x["r"])
    kept = F.filter("gs", lambda x, i: rest(F.col("gs"), i) >= least * least * F.col("sq"))
    probes = of.select("grp", "value", F.explode(kept).alias("x")).select("grp", "value", F.col("x.g").alias("g"))
    pairs = probes.join(index.select("grp", "g", "entry_id", "name"), ["grp", "g"]).select("grp", "value", "entry_id", "name").distinct()
    # the cosine of the pairs found, from all their grams
    entry = index.groupBy("grp", "entry_id", "name").agg(F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("ws"), F.first("entry_norm").alias("entry_norm"), F.first("entry_words").alias("entry_words"))
    hits = pairs.join(entry, ["grp", "entry_id", "name"]).join(typed, ["grp", "value"]).join(of.select("grp", "value", F.sqrt("sq").alias("norm")), ["grp", "value"])
    dot = F.aggregate("gram", F.lit(0.0), lambda t, g: t + F.coalesce(F.pow(F.try_element_at("ws", g), F.lit(2.0)), F.lit(0.0)))
    hits = hits.withColumn("cosine", dot / (F.col("norm") * F.col("entry_norm"))).where(F.col("cosine") >= least)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["score"] = [similarity(list(w), list(e), c) for w, e, c in zip(b["words"], b["entry_words"], b["cosine"])]
            yield b[["grp", "value", "entry_id", "score"]]

    scored = hits.select("grp", "value", "entry_id", "words", "entry_words", "cosine").mapInPandas(verify, "grp string, value string, entry_id long, score double")
    per = scored.groupBy("grp", "value", "entry_id").agg(F.max("score").alias("score"))
    # best and runner-up by two aggregates, so that no window gathers a value's candidates
    best = per.groupBy("grp", "value").agg(F.max(F.struct("score", "entry_id")).alias("b"), F.sort_array(F.collect_list("score"), False).alias("s"))
    second = F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))
    ok = (F.col("b.score") >= THRESHOLD) & (F.col("b.score") - second >= F.when(F.col("b.score") > 0.999, 0.001).otherwise(MARGIN))
    chosen = best.where(ok).select("grp", "value", F.col("b.entry_id").alias("entry_id"), F.col("b.score").alias("score"))
    return typed.select("grp", "value").join(chosen, ["grp", "value"], "left").select("grp", "value", F.coalesce("entry_id", F.lit(0)).cast("long").alias("entry_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def map_to_canonical(rows: DataFrame, entries: DataFrame, group: str, value: str) -> DataFrame:
    """rows with entry_id and score: the entry of the row's group that its value means, 0 if it fits none.

    Rows with a null or blank value have no result and are left out; other columns of rows are kept.
    """
    keyed = rows.where(F.trim(F.regexp_replace(F.col(value), r"(?U)\s", "")) != "")
    counts = keyed.groupBy(F.col(group).alias("grp"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "values")
    found = match_values(counts, entries)
    known = materialise(counts.join(found, ["grp", "value"], "left").select(F.col("grp").alias(group), F.col("value").alias(value), "n", F.coalesce("entry_id", F.lit(0)).alias("entry_id"), F.coalesce("score", F.lit(0.0)).alias("score")), "mapped")
    return join_back(keyed, known, [group, value], ["entry_id", "score"])


def found_entries(mentions: DataFrame, reference: DataFrame) -> DataFrame:
    """(mention_id, category_id) for mentions whose category isn't blank and isn't the name of an entry of its dimension."""
    ref = reference.select("category_id", "category", "dimension_name", "aliases")
    names = F.explode(F.array_union(F.array("category"), F.coalesce("aliases", F.array().cast("array<string>"))))
    entries = ref.select(F.col("dimension_name").alias("grp"), F.col("category_id").alias("entry_id"), names.alias("name")).where("name is not null")
    same = ref.select("dimension_name", "category").distinct()
    rows = mentions.select("mention_id", "dimension_name", "category").where("category is not null").distinct()
    rows = rows.join(same, ["dimension_name", "category"], "left_anti")
    out = map_to_canonical(rows, entries, "dimension_name", "category")
    return out.select("mention_id", F.col("entry_id").alias("category_id")).distinct()
