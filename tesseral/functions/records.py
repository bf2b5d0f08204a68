"""Question-answer records of different shapes in one form, as array and map expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.functions.columns import col, content_id


def question_kind(labels: Column | str) -> Column:
    return F.when(F.forall(col(labels), lambda x: F.lower(x).isin("yes", "no")), "yes_no").otherwise("undefined")


def supporting_sentences(facts: Column | str, contexts: Column | str) -> Column:
    """array<struct<title, contents>> of facts array<struct<title, idx>> in contexts array<struct<title, sentences>>; null if one is missing."""
    def find(fact):
        hit = F.try_element_at(F.filter(col(contexts), lambda c: c["title"] == fact["title"]), F.lit(1))
        return F.struct(fact["title"].alias("title"), F.try_element_at(hit["sentences"], fact["idx"] + 1).alias("contents"))

    found = F.transform(col(facts), find)
    return F.when(F.forall(found, lambda f: f["contents"].isNotNull()), found)


def choice_answer(options: Column | str, letter: Column | str) -> Column:
    """The text of the option a letter names; null if it names none."""
    return F.try_element_at(col(options), F.upper(F.trim(col(letter))))


def chosen_letter(response: Column | str) -> Column:
    """The first of A to D that stands alone in a response."""
    return F.nullif(F.regexp_extract(F.upper(col(response)), r"\b([ABCD])\b", 1), F.lit(""))


def with_aliases(answer: Column | str, aliases: Column | str) -> Column:
    return F.array_distinct(F.array_compact(F.concat(F.array(col(answer)), F.coalesce(col(aliases), F.array().cast("array<string>")))))


def zipped_results(titles: Column | str, texts: Column | str) -> Column:
    """Parallel arrays as array<struct<title, contents>>, entries without text dropped."""
    both = F.transform(F.arrays_zip(col(titles).alias("t"), col(texts).alias("c")), lambda x: F.struct(x["t"].alias("title"), x["c"].alias("contents")))
    return F.filter(both, lambda x: F.trim(x["contents"]) != "")


def title_of_url(url: Column | str) -> Column:
    return F.replace(F.element_at(F.split(col(url), "/"), -1), F.lit("_"), F.lit(" "))


def byte_range(html: Column | str, start: Column | str, end: Column | str) -> Column:
    """The text between two byte positions of a UTF-8 page."""
    return F.decode(F.substring(F.encode(col(html), "UTF-8"), col(start) + 1, col(end) - col(start)), "UTF-8")


def joined_title(title: Column | str, body: Column | str) -> Column:
    """Title and text in one, with a full stop unless the title ends in a mark."""
    t, b = col(title), col(body)
    return F.when(t.isNull() | (t == ""), b).when(b.isNull() | (b == ""), t).otherwise(F.concat(t, F.when(t.rlike(r"[.!?;:]$"), F.lit(" ")).otherwise(F.lit(". ")), b))


def corpus_of_records(records: DataFrame, facts: str = "supporting", contexts: str = "contexts") -> DataFrame:
    """(doc_id, title, contents): the distinct texts of all records' supporting and retrieved contexts, by content."""
    both = F.explode(F.concat(F.coalesce(F.col(facts), F.array().cast("array<struct<title:string,contents:string>>")), F.coalesce(F.col(contexts), F.array().cast("array<struct<title:string,contents:string>>"))))
    x = records.select(both.alias("x")).where("trim(x.contents) <> ''").select(content_id("x.contents").alias("doc_id"), "x.title", "x.contents")
    return x.groupBy("doc_id").agg(F.min("title").alias("title"), F.first("contents").alias("contents"))


PASSAGE = "array<struct<type:string,title:string,contents:string>>"


def _protocol(df: DataFrame, key: str, question: str, labels: Column, facts: Column, contexts: Column, kind: Column | None = None) -> DataFrame:
    """id, question, answer_labels, question_type, original_id, supporting_facts, retrieval_contexts; ids are hashes of the original's."""
    k = question_kind("answer_labels") if kind is None else kind
    out = df.select(F.col(key).cast("string").alias("original_id"), F.col(question).alias("question"), labels.alias("answer_labels"), facts.alias("supporting_facts"), contexts.alias("retrieval_contexts"), *([] if kind is None else [kind.alias("__k")]))
    return out.select(content_id(F.concat_ws("|", "original_id", "question")).alias("id"), "question", "answer_labels", (k if kind is None else F.col("__k")).alias("question_type"), "original_id", "supporting_facts", "retrieval_contexts")


def _passages(c: Column | str, kind: str, contents) -> Column:
    return F.transform(col(c), lambda x: F.struct(F.lit(kind).alias("type"), x["title"].alias("title"), contents(x).alias("contents")))


def facts_in_contexts(df: DataFrame, key: str = "_id") -> DataFrame:
    """Two-hop records (question, answer, supporting_facts: title and idx, context: title and sentences); a record without one of its facts is left out."""
    facts = supporting_sentences("supporting_facts", "context")
    rows = df.withColumn("__f", F.transform(facts, lambda f: F.struct(F.lit("wikipedia").alias("type"), f["title"].alias("title"), f["contents"].alias("contents")))).where(F.col("__f").isNotNull())
    return _protocol(rows, key, "question", F.array("answer"), F.col("__f"), _passages("context", "wikipedia", lambda x: F.array_join(x["sentences"], "")))


def decomposed(df: DataFrame) -> DataFrame:
    """Records with paragraphs (title, paragraph_text) and steps that point at them by place; aliases are answers too."""
    contexts = _passages("paragraphs", "wikipedia", lambda x: x["paragraph_text"])
    facts = F.transform("question_decomposition", lambda s: F.get(contexts, s["paragraph_support_idx"]))
    labels = F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>")))
    return _protocol(df, "id", "question", labels, facts, contexts)


def with_subject(df: DataFrame) -> DataFrame:
    """Records of a fact (subj, prop, obj) with possible answers as JSON; a record without a subject is left out."""
    fact = F.array(F.struct(F.lit("wikidata").alias("type"), F.col("subj").alias("title"), F.col("obj").alias("contents")))
    return _protocol(df.where("subj is not null"), "id", "question", F.from_json("possible_answers", "array<string>"), fact, F.array().cast(PASSAGE))


def with_searches(df: DataFrame) -> DataFrame:
    """Records with answer aliases, page titles, and search results in parallel arrays."""
    pages = F.transform("page_titles", lambda t: F.struct(F.lit("wikipedia").alias("type"), t.alias("title"), F.lit(None).cast("string").alias("contents")))
    found = F.transform(F.arrays_zip(col("search_titles").alias("t"), col("search_contexts").alias("c")), lambda x: F.struct(F.lit("BingSearch").alias("type"), x["t"].alias("title"), x["c"].alias("contents")))
    return _protocol(df, "question_id", "question", F.col("aliases"), F.array().cast(PASSAGE), F.concat(pages, found))


def with_page(df: DataFrame) -> DataFrame:
    """Records with answers and the address of the page that has them."""
    fact = F.array(F.struct(F.lit("wikipedia").alias("type"), title_of_url("url").alias("title"), F.lit(None).cast("string").alias("contents")))
    return _protocol(df, "url", "question", F.col("answers"), fact, F.array().cast(PASSAGE))


def with_choices(df: DataFrame) -> DataFrame:
    """Multiple-choice records (question, options map, answer letter): the option's text is the answer; without one the record is left out."""
    rows = df.withColumn("__a", choice_answer("options", "answer")).where("__a is not null")
    return _protocol(rows, "id", "question", F.array("__a"), F.array().cast(PASSAGE), F.array().cast(PASSAGE), F.lit("choice"))


def aliases_to_ids(df: DataFrame) -> DataFrame:
    """(title, qid) from (qid, aliases); a title of several ids has the last in order."""
    return df.select(F.explode("aliases").alias("title"), "qid").groupBy("title").agg(F.max("qid").alias("qid"))


FORMATS = {"hotpotqa": facts_in_contexts, "two_wiki": facts_in_contexts, "musique": decomposed, "popqa": with_subject, "triviaqa": with_searches, "webqa": with_page, "mirage": with_choices}


def normalised(df: DataFrame, name: str) -> DataFrame:
    """Records of a named format in the common protocol; an unknown name is an error."""
    if name not in FORMATS:
        raise ValueError(f"unknown record format {name!r}: one of {', '.join(FORMATS)}")
    return FORMATS[name](df)
