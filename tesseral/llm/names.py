"""Linking variant spellings of persons' and organisations' names (problem 6).

Method: a prefix-filtered set-similarity join on token q-grams, verified by soft weighted token similarity.

1. Distinct spellings are cut into tokens (accents, case, punctuation and joined words undone).
2. Each distinct token is a set of 3-grams with positions.  Two tokens within one edit (swap included) share at
   least one of the five rarest grams of each, so the join runs over these prefixes only, and the exact edit
   distance verifies.  A rare token is then a variant of the far more frequent token it resembles; the counts of
   a token and its variants together are its soft frequency, and the logarithm of its rarity is its weight.
3. The heaviest token of a name (the family name, the body's place) is its block key.  The other tokens of two
   names in a block must agree softly: given names by nickname or initial, bodies by abbreviation or initial.
   What agrees must carry most of the name's weight, so that rare tokens count more.
4. Spellings of an entity are paired first and mentions joined to the pairs, so a text that a third of all
   mentions share costs no more than the pairs it really has.

Defined results: null and blank texts, and texts without a token of two letters, link to nothing; initials
that fit two given names of a family link to nothing; repeated mentions count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.functions.strings import fold, osa, unleet
from tesseral.operators.lookup import join_back, shuffled
from tesseral.session import materialise

MAX_SQUARINGS = 20  # chains of a million variants
HOT_FORM = 10_000  # mentions of a form that one bucket takes
PREFIX = 5  # rarest grams of a token that any token within one edit must meet
LEAST_TARGET = 4  # letters of a token that others may be variants of: within one edit of three letters lie other names
AGREED = 0.6  # share of a name's weight that must agree with its entity
# Given names and their short forms; a short form may stand for several names.
GIVEN = """alexander alex sandy xander al|alexandra alex sandy sasha|andrew andy drew|anthony tony|barbara barb babs|benjamin ben benny|catherine cathy kate katie cat|charles charlie chuck chas|
christopher chris kit|christine chris tina|daniel dan danny|david dave|deborah deb debbie|donald don donnie|dorothy dot dottie dolly|edward ed eddie ned ted|eleanor ellie nell nora|elizabeth liz beth betty eliza lizzie bess libby|
frances fran franny|francis frank|frederick fred freddie freddy|george|gerald gerry jerry|gregory greg|harold hal harry|henry hank harry|irene rena renie|james jim jimmy jamie|janet jan|jennifer jen jenny|john jack johnny|joseph joe joey|judith judy|
katherine kate kathy katie kath kit|kenneth ken kenny|lawrence larry lars laurie|leonard len lenny|margaret maggie meg peggy marge madge greta|matthew matt|michael mike mick mickey|nancy nan|nathaniel nat nate|nicholas nick nicky|oliver ollie|
pamela pam|patricia pat patty trish tricia|patrick pat paddy|peter pete|philip phil|raymond ray|rebecca becky|richard rick dick rich|robert bob bobby rob robbie bert|ronald ron ronnie|samuel sam|samantha sam|stephen steve stevie|steven steve|susan sue susie|
theodore ted theo teddy|theresa terry tess|thomas tom tommy|timothy tim|ursula uschi ursel|victoria vicky vicki tori|vincent vince|virginia ginny|walter walt|william bill billy will liam|yvonne evie vonnie|zachary zach zack"""
FORMAL: dict[str, list[str]] = {}
for _line in GIVEN.replace("\n", "").split("|"):
    _formal, *_short = _line.split()
    for _n in [_formal, *_short]:
        FORMAL.setdefault(_n, []).append(_formal)
# Words of organisations' names and their usual abbreviations.
BODY = """university univ|hospital hosp|department dept dep|health hlth|council cncl|district dist|company co coy|corporation corp|authority auth|service svc serv|services svcs|laboratory lab labs|institute inst|research res rsrch|
centre center ctr cntr|medical med|foundation fdn fndn found|community comm cmty|bureau bur|weather wthr|water wtr|fire|food|port|rail|agency agcy agy|ministry min|office off ofc|national natl nat|international intl|regional regl reg|association assn assoc|
committee cttee|commission commn|government govt gov|education educ ed|school sch|college coll|management mgmt|society soc|transport transp|public pub|environment env|emergency emerg|police|ambulance|airport|energy|municipal muni|county cty|state|federal fed"""
BODY_WORDS = {w: line.split()[0] for line in BODY.replace("\n", "").split("|") for w in line.split()}
# What carries no name.
TITLES = frozenset("dr prof professor mr mrs ms miss mx cr sir dame lady lord hon rev fr sen rep gov capt col gen sgt phd dphil msc bsc mba esq jr sr ii iii iv et al".split())
PARTICLES = frozenset("van von der den ter de di da do dos du del della el la le les al bin ibn ben af av zu zum zur st san santa mac".split())
FILLERS = frozenset("the of and for a an in at on to inc ltd pty plc llc limited incorporated gmbh ag sa bv co-op de des du".split())
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z]{3})(?=[A-Z][^\W\d_A-Z]{2})")


def _undone(kind: str, w: str) -> list[str]:
    """A word that runs a given name and a particle together, as two."""
    low = w.lower()
    if kind == "person" and low not in FORMAL:
        for n in range(len(low) - 2, max(2, len(low) - 4), -1):
            if low[n:] in PARTICLES and low[:n] in FORMAL:
                return [w[:n], w[n:]]
    return [w]


def tokens(kind: str, text: str) -> tuple[list[str], list[str]]:
    """The words (three letters or more) and the initials of a name, in their order, without titles and fillers."""
    s = re.sub("[\\u200b-\\u200f\\u2060\\ufeff\\u00ad]", "", text)
    if kind == "person":
        s = re.sub(r"[(\[].*?[)\]]", " ", s)
        s = re.sub(r",\s*(?:MD|M\.D\.|PhD|Ph\.D\.)\s*$", "", s)
    else:
        s = re.sub(r"[(\[]\s*[A-Z&.]{2,6}\s*[)\]]", " ", s)
    s = _CAMEL.sub(" ", s)
    words, initials = [], []
    raw = [x for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", s) for x in _undone(kind, w)]
    shouted = not any(len(w) > 3 and not w.isupper() for w in raw)
    for w in raw:
        low = unleet(re.sub(r"[^a-z0-9а-я]", "", fold(w)) or fold(w))
        if not any(c.isalpha() for c in low):
            continue
        if kind == "person":
            if low in TITLES or low in PARTICLES and len(raw) > 2:
                continue
            if len(low) == 1 or (len(low) <= 3 and w.isupper() and not shouted):
                initials += list(low)
            elif len(low) >= 2:
                words.append(low if low in FORMAL else low.replace("rn", "m"))  # "rn" and "m" look alike
        elif low in FILLERS:
            continue
        elif len(low) == 1:
            initials.append(low)
        elif len(low) >= 3 or low in BODY_WORDS:
            words.append(BODY_WORDS[low] if low in BODY_WORDS else low.replace("rn", "m"))
    return words, initials


def token_grams(w: str) -> list[tuple[str, int]]:
    p = f"^{w}$"
    return [(p[i : i + 3], i) for i in range(len(p) - 2)]


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        both = [tokens(k, t) for k, t in zip(b["kind"], b["text"])]
        yield b.assign(words=[x for x, _ in both], initials=[y for _, y in both])


def anchors(spark) -> DataFrame:
    """Known words, which no other word absorbs."""
    rows = [("person", w) for w in FORMAL] + [("organization", w) for w in sorted(set(BODY_WORDS.values()))]
    return spark.createDataFrame(rows, "kind string, w string")


def token_classes(forms: DataFrame) -> DataFrame:
    """(kind, w, class, soft): each token's class (the token it is a variant of, or itself) and the class's count."""
    spark = forms.sparkSession
    counted = forms.select("kind", "n", F.explode(F.array_distinct("words")).alias("w")).groupBy("kind", "w").agg(F.sum("n").alias("df"))
    known = F.broadcast(anchors(spark).withColumn("anchor", F.lit(True)))  # the fixed list above
    vocabulary = counted.join(known, ["kind", "w"], "full").select("kind", "w", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    vocabulary = materialise(vocabulary, "vocabulary")

    def of_tokens(batches):
        for b in batches:
            out = [(k, w, d, a, g, i) for k, w, d, a in zip(b["kind"], b["w"], b["df"], b["anchor"]) if len(w) >= 3 for g, i in token_grams(w)]
            yield pd.DataFrame(out, columns=["kind", "w", "df", "anchor", "g", "at"])

    g = vocabulary.mapInPandas(of_tokens, "kind string, w string, df long, anchor boolean, g string, at int")
    rarity = g.groupBy("kind", "g").agg(F.count(F.lit(1)).alias("gdf"))
    g = g.join(shuffled(rarity), ["kind", "g"]).groupBy("kind", "w", "df", "anchor").agg(F.slice(F.array_sort(F.collect_list(F.struct("gdf", "g", "at"))), 1, PREFIX).alias("p"))
    prefix = g.select("kind", "w", "df", "anchor", F.explode("p").alias("p")).select("kind", "w", "df", "anchor", "p.g", "p.at")
    # one edit moves what is behind it by the difference of lengths, and what is before it not at all: length and
    # place are part of the key, so a gram that many tokens share isn't one group
    size = F.length("w")
    shifts = F.array(*[F.struct((size + n).alias("n"), (F.col("at") + m).alias("at")) for n, m in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])
    a = prefix.withColumn("to", F.explode(shifts)).select("kind", "w", "df", "anchor", "g", F.col("to.n").alias("n"), F.col("to.at").alias("at")).alias("a")
    b = prefix.withColumn("n", size).where(size >= 3).alias("b")
    # a may be a variant of b: b is an anchor, or far more frequent, or a is rare and b precedes it
    weak, rank = F.col("a.df") <= 2, lambda x: F.struct(F.col(f"{x}.df"), F.col(f"{x}.w"))
    may = ~F.col("a.anchor") & ((F.col("b.anchor") & (F.col("b.df") >= F.col("a.df"))) | (F.col("b.df") >= 3 * F.col("a.df")) | (weak & (rank("b") > rank("a"))))
    on = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.w") != F.col("b.w")) & may & (F.length("b.w") >= LEAST_TARGET)
    pairs = a.join(shuffled(b), on).select(F.col("a.kind").alias("kind"), F.col("a.w").alias("w"), F.col("b.w").alias("other"), F.col("b.df").alias("odf"), F.col("b.anchor").alias("oa"))
    # a swap is two plain edits: what lies beyond two is dropped in the JVM, before pairs are made distinct
    pairs = pairs.where(F.levenshtein("w", "other", 2) >= 0).distinct()

    def verify(batches):
        for x in batches:
            yield x[[osa(p, q, 1) <= 1 for p, q in zip(x["w"], x["other"])]]

    close = pairs.mapInPandas(verify, "kind string, w string, other string, odf long, oa boolean")
    to = close.groupBy("kind", "w").agg(F.max(F.struct("oa", "odf", "other")).alias("m")).select("kind", "w", F.col("m.other").alias("to"))
    link = materialise(vocabulary.join(shuffled(to), ["kind", "w"], "left").select("kind", "w", "df", F.coalesce("to", "w").alias("to")), "links")
    for _ in range(MAX_SQUARINGS):  # a variant's variant: links lead to ever more frequent tokens, so chains end
        step = link.select("kind", F.col("w").alias("to"), F.col("to").alias("far"))
        far = materialise(link.join(shuffled(step), ["kind", "to"]).select("kind", "w", "df", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "links")
        link = far.select("kind", "w", "df", "to")
        if not far.where("moved").take(1):
            break
    else:
        raise RuntimeError("links between variants do not end")
    soft = link.groupBy("kind", "to").agg(F.sum("df").alias("soft"))
    return link.join(shuffled(soft), ["kind", "to"]).select("kind", "w", F.col("to").alias("class"), "soft")


def _describe(total: dict[str, int], met: dict[str, int]):
    """Key, and what else the name says: a given name (or options, or an initial), or the body's words."""
    from math import log1p

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for form, kind, initials, parts in zip(b["form"], b["kind"], b["initials"], b["parts"]):
                parts = [(p["class"], int(p["soft"]), log1p(total[kind] / max(1, int(p["soft"])))) for p in parts]
                known = FORMAL if kind == "person" else BODY_WORDS
                real = [p for p in parts if p[0] in known or len(p[0]) > 3]
                if len(real) >= (2 if kind == "person" else 1) and any(p[0] not in known for p in real):  # short scraps beside a full name say nothing
                    parts = real
                rest = [p for p in parts if p[0] not in known] or parts
                if not rest:
                    continue
                key = max(rest, key=lambda p: (p[2], len(p[0]), p[0]))
                others = [p for p in parts if p is not key]
                weight = sum(p[2] for p in parts) or 1.0
                initials = list(initials)
                if kind == "person":
                    given = [p for p in others if p[0] in FORMAL]
                    unknown = [p for p in others if p[0] not in FORMAL]
                    if given:
                        said = given[0]
                        options = [f for f in FORMAL[said[0]] if met.get(f)] or FORMAL[said[0]]
                        options = sorted(options, key=lambda f: (-met.get(f, 0), f[0] != said[0][0], f))
                    elif unknown:
                        said = unknown[0]
                        options = [said[0]] if said[1] >= 3 or len(said[0]) <= 3 else []
                    else:
                        said, options = None, []
                    initial = said[0][0] if said else initials[0] if initials else ""
                    agreed = (key[2] + (said[2] if said else 0)) / weight
                    if said and not options:  # a given name met once or twice: no more than its initial
                        options = []
                    out.append((form, kind, key[0], options, initial, "", agreed))
                else:
                    body = sorted({p[0] for p in others if len(p[0]) > 3 or p[0] in known})
                    out.append((form, kind, key[0], body, initials[0] if initials and len(body) else "", "", 1.0))
            yield pd.DataFrame(out, columns=["form", "kind", "key", "options", "initial", "said", "agreed"])

    return run


DESCRIBED = "form long, kind string, key string, options array<string>, initial string, said string, agreed double"


def _persons(d: DataFrame) -> DataFrame:
    """(form, entity): family and given name; initials and shared short forms as the family's names decide."""
    d = d.where("kind = 'person' and agreed >= " + str(AGREED))
    sure = d.where(F.size("options") == 1).select("form", "key", F.col("options")[0].alias("given"))
    strong = sure.select("key", "given").distinct()
    multi = d.where(F.size("options") > 1).select("form", "key", "options", F.explode("options").alias("given"))
    fits = multi.join(shuffled(strong), ["key", "given"]).groupBy("form").agg(F.countDistinct("given").alias("k"), F.min("given").alias("given"))
    several = d.where(F.size("options") > 1).select("form", "key", F.col("options")[0].alias("first")).join(shuffled(fits), "form", "left").where("k is null or k = 1").select("form", "key", F.coalesce("given", "first").alias("given"))
    names = strong.unionByName(several.select("key", "given")).distinct()
    by_initial = names.groupBy("key", F.substring("given", 1, 1).alias("initial")).agg(F.count(F.lit(1)).alias("k"), F.min("given").alias("given"))
    short = d.where((F.size("options") == 0) & (F.col("initial") != "")).select("form", "key", "initial").join(shuffled(by_initial), ["key", "initial"], "left")
    short = short.where("k is null or k = 1").select("form", "key", F.coalesce("given", F.concat("initial", F.lit("."))).alias("given"))
    alone = d.where((F.size("options") == 0) & (F.col("initial") == "")).select("form", "key", F.lit("").alias("given"))
    return sure.unionByName(several).unionByName(short).unionByName(alone).select("form", F.concat_ws("|", F.lit("person"), "key", "given").alias("entity"))


def _bodies(d: DataFrame) -> DataFrame:
    """(form, entity): place and kind of body; an initial is the word that the bodies' names have in its place."""
    d = d.where("kind = 'organization'").withColumn("sig", F.concat_ws(" ", "options"))
    full = d.where("initial = ''")
    kinds = full.groupBy("sig", "options").agg(F.count(F.lit(1)).alias("forms")).where("forms >= 2")
    worded = kinds.select("sig", "options", "forms", F.explode("options").alias("w"))
    pattern = F.concat_ws(" ", F.array_remove("options", F.col("w")))
    patterns = worded.select(pattern.alias("pattern"), F.substring("w", 1, 1).alias("initial"), "sig", "forms")
    best = patterns.groupBy("pattern", "initial").agg(F.max(F.struct("forms", "sig")).alias("m")).select("pattern", "initial", F.col("m.sig").alias("full"))
    short = d.where("initial <> ''").select("form", "key", "initial", F.col("sig").alias("pattern")).join(shuffled(best), ["pattern", "initial"], "left")
    short = short.select("form", "key", F.coalesce("full", F.concat_ws(" ", "pattern", "initial")).alias("sig"))
    return full.select("form", "key", "sig").unionByName(short).select("form", F.concat_ws("|", F.lit("organization"), "key", "sig").alias("entity"))


def name_entities(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forms, entities): forms (kind, text, n, form, words, initials) and (form, entity) for mentions (id, kind, text)."""
    named = mentions.where("text is not null").select("id", "kind", "text").distinct()
    forms = named.groupBy("kind", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("form", F.monotonically_increasing_id())
    forms = materialise(forms.mapInPandas(_tokenise, "kind string, text string, n long, form long, words array<string>, initials array<string>"), "forms")
    classes = materialise(token_classes(forms), "classes")
    total = {r["kind"]: r["n"] for r in forms.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # one row for each kind
    # at most one row for each name of the fixed list
    met = {r["class"]: r["soft"] for r in classes.where(F.col("class").isin(*sorted({f for o in FORMAL.values() for f in o})) & (F.col("kind") == "person")).select("class", "soft").distinct().collect()}
    parts = forms.select("form", "kind", F.posexplode("words").alias("at", "w")).join(shuffled(classes), ["kind", "w"]).groupBy("form", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "class", "soft"))).alias("parts"))
    parts = parts.join(shuffled(forms.select("form", "initials")), "form").select("form", "kind", "initials", "parts")
    described = materialise(parts.mapInPandas(_describe(total, met), DESCRIBED), "described")
    return forms, _persons(described).unionByName(_bodies(described))


def name_members(mentions: DataFrame) -> DataFrame:
    """(mention_id, entity, links): a row for each mention with a name, its entity, and how many mentions name it otherwise.

    Nothing is expanded into pairs: the links of a mention are the entity's mentions less those of its own text.
    """
    forms, entities = name_entities(mentions)
    known = materialise(entities.join(shuffled(forms.select("kind", "text", "form", "n")), "form"), "members")
    total = known.groupBy("entity").agg(F.sum("n").alias("all"))
    sized = known.join(shuffled(total), "entity").select("kind", "text", "entity", (F.col("all") - F.col("n")).alias("links"), "n")
    rows = mentions.where("text is not null").select("id", "kind", "text").distinct()
    return join_back(rows, materialise(sized, "sized"), ["kind", "text"], ["entity", "links"]).select(F.col("id").alias("mention_id"), "entity", "links")


def linked_pairs(mentions: DataFrame, hot: int = HOT_FORM) -> DataFrame:
    """(mention_a, mention_b): pairs of mentions (id, kind, text) that name one entity in different texts, each once.

    Forms of an entity are paired, then their mentions join the pairs; the mentions of a form with more than `hot` of
    them are spread over buckets of that size, so a form that a third of all mentions share is no one task's.
    """
    forms, entities = name_entities(mentions)
    buckets = forms.select("form", F.ceil(F.col("n") / hot).cast("int").alias("k"))
    entities = materialise(entities.join(shuffled(buckets), "form"), "entities")
    a, b = entities.alias("a"), entities.alias("b")
    pairs = a.join(shuffled(b), (F.col("a.entity") == F.col("b.entity")) & (F.col("a.form") < F.col("b.form")))
    split = lambda x, name: F.explode(F.sequence(F.lit(0), F.col(f"{x}.k") - 1)).alias(name)
    pairs = pairs.select(F.col("a.form").alias("fa"), F.col("b.form").alias("fb"), split("a", "sa"), F.col("b.k").alias("kb"))
    pairs = pairs.select("fa", "sa", "fb", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("sb"))
    rows = mentions.where("text is not null").select("id", "kind", "text").distinct()
    known = materialise(forms.join(shuffled(buckets), "form").select("kind", "text", "form", "k", "n"), "numbered")
    ids = join_back(rows, known, ["kind", "text"], ["form", "k"]).select("id", "form", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("s"))
    ids = materialise(ids, "ids")
    out = pairs.join(shuffled(ids.select(F.col("id").alias("x"), F.col("form").alias("fa"), F.col("s").alias("sa"))), ["fa", "sa"])
    out = out.join(shuffled(ids.select(F.col("id").alias("y"), F.col("form").alias("fb"), F.col("s").alias("sb"))), ["fb", "sb"])
    return out.select(F.least("x", "y").alias("mention_a"), F.greatest("x", "y").alias("mention_b")).where("mention_a < mention_b").distinct()
