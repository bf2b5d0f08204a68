"""Values, names, pages and languages on small fixtures with known results."""

import random

from tesseral.llm import boilerplate, canonical, language, names

REF = [(1, "bushfire", "event", ["wildfire"]), (2, "tropical cyclone", "event", None), (3, "hepatitis a", "disease", None), (4, "hepatitis b", "disease", None), (5, "nurse", "person", None), (6, "flood", "event", None), (7, "water utility", "organization", None), (8, "research institute", "organization", None)]


def test_values(spark):
    ref = spark.createDataFrame(REF, "category_id long, category string, dimension_name string, aliases array<string>")
    cases = [
        ("bushfire", "event", None), ("Bushfire", "event", 1), ("wildfire", "event", 1), ("WILDFIRE?", "event", 1), ("bushfrie", "event", 1), ("cyclone, tropical", "event", 2), ("type=tropical cyclone", "event", 2), ("1. flood", "event", 6),
        ("flood (severe)", "event", 6), ("flod", "event", 6), ("hepatitisa", "disease", 3), ("b, hepatitis", "disease", 4), ("hep a", "disease", 3), ("hepatitis", "disease", 0), ("a hepatitis", "disease", 3), ("nruse", "person", 5), ("chef", "person", 0), ("xx", "event", 0),
        ("waterutility", "organization", 7), ("rsrch inst", "organization", 8), ("kitchen", "organization", 0), ("bushfire", "disease", 0), ("f1ood", "event", 6), ("flood", "unknown group", 0), (None, "event", None), ("  ", "event", None), (" ​", "event", 0), ("x" * 3000, "event", 0),
    ]
    rows = [(i, d, c, 7) for i, (c, d, _) in enumerate(cases)] + [(1, "event", "Bushfire", 7)]
    m = spark.createDataFrame(rows, "mention_id long, dimension_name string, category string, score int")
    got = {r["mention_id"]: r["category_id"] for r in canonical.found_entries(m, ref).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases) if w is not None}
    assert canonical.found_entries(m.limit(0), ref).count() == 0
    assert {r["category_id"] for r in canonical.found_entries(m, ref.limit(0)).collect()} == {0}
    kept = canonical.map_to_canonical(m, spark.createDataFrame([("event", 1, "bushfire")], "grp string, entry_id long, name string"), "dimension_name", "category")
    assert "score" in kept.columns and dict(kept.dtypes)["score"] == "double"


PEOPLE = ["Katherine Hokrablobre", "Kate Hokrablobre", "K. Hokrablobre", "Hokrablobre, Katherine", "HOKRABLOBRE, Kate", "Katherine Hokráblobre", "Katherine Hokrablobrre", "katherine.hokrablobre", "KatherineHokrablobre", "Dr. Katherine Hokrablobre, PhD", "KW Hokrablobre"]
OTHERS = ["Robert Hokrablobre", "Bob Hokrablobre"]
BODIES = ["Vetrusomi District Council", "District Council of Vetrusomi", "Vetrusomi Dist Cncl.", "Vetrusomi D. Council", "VETRUSOMI DISTRICT COUNCIL", "The Vetrusomi District Council Pty Ltd", "Vetrusomi District Council (VDC)", "Vetrusomi Ditsrict Council", "Vetrusomi-District-Council", "District Council (Vetrusomi)"]
PLACES = ["Vetrusomi Fire Service", "Vetrusomi Fire Svc", "Lakepotho District Council"]


def test_names(spark):
    rows = [(i, "person", t) for i, t in enumerate(PEOPLE)] + [(100 + i, "person", t) for i, t in enumerate(OTHERS)] + [(200 + i, "organization", t) for i, t in enumerate(BODIES)] + [(300 + i, "organization", t) for i, t in enumerate(PLACES)]
    rows += [(400, "person", PEOPLE[0]), (0, "person", PEOPLE[0]), (500, "person", None), (501, "person", ""), (502, "person", "?!"), (503, "organization", "x" * 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, kind string, text string, form string").select("id", "kind", "text")
    got = {tuple(r) for r in names.linked_pairs(df).collect()}
    want = set()
    groups = [[(i, t) for i, k, t in rows if k == "person" and t in PEOPLE], [(100, OTHERS[0]), (101, OTHERS[1])], [(200 + i, t) for i, t in enumerate(BODIES)], [(300, PLACES[0]), (301, PLACES[1])]]
    for g in groups:
        want |= {(a, b) for a, x in g for b, y in g if a < b and x != y}
    assert got == want
    assert names.linked_pairs(df.limit(0)).count() == 0


def test_ambiguous_initials_link_to_nothing(spark):
    df = spark.createDataFrame([(1, "person", "Robert Zuplodemi"), (2, "person", "Raymond Zuplodemi"), (3, "person", "R. Zuplodemi")], "id long, kind string, text string")
    assert names.linked_pairs(df).count() == 0


def page(i, article, site="Hill Post"):
    head = ["News | Sport | Weather | Video", f"{site} uses cookies to measure traffic", "News > Local"] if i % 2 else ["* News", "* Sport", "* Weather"]
    tail = ["", "Related stories", "1. A bridge was closed after the storm", "2. The council met on Friday", "Log in to leave a comment", "I was there. It was bad. Very bad.", f"© {2020 + i} {site}. All rights reserved.", "Made in Springfield with care"]
    return head, article, tail


def test_pages(spark):
    rows, want = [], set()
    for i in range(12):
        title = f"Storm number {i} hits the coast near town"
        article = [title, "By Ann Lee", "Share this story", "", "The storm came in the night. It took roofs from many houses.", "ADVERTISEMENT - CONTINUE READING BELOW", '"We saw it come," a farmer said.', "What happens next", f"* Hilltown: {i}", "The council will meet on Monday. Help is on its way."]
        inner = {2, 5}
        if i == 11:
            title, article, inner = None, [], set()
        head, body, tail = page(i, article)
        lines = head + body + tail
        rows.append((f"d{i}", "hill.example", "Hill Post", None if i == 10 else title, "\n".join(lines), i))
        out = list(range(len(head))) + [len(head) + j for j in inner] + list(range(len(head) + len(body), len(lines)))
        want |= {(f"d{i}", j) for j in out if lines[j].strip()}
    rows += [("n", "hill.example", "Hill Post", "t", None, 0), ("e", None, None, None, "", 0), ("b", None, None, None, " \n ", 0), rows[0]]
    df = spark.createDataFrame(rows, "document_id string, host string, site string, title string, content string, line_no int")
    for bound in (1000, 0):
        got = {tuple(r) for r in boilerplate.furniture_lines(df, ["document_id"], max_broadcast=bound).collect()}
        assert got == want
    bodies = {r["document_id"]: r["body"] for r in boilerplate.main_body(df, ["document_id"]).collect()}
    assert bodies["d0"].startswith("Storm number 0") and bodies["d11"] is None and bodies["n"] is None and len(bodies) == 15
    assert boilerplate.furniture_lines(df.limit(0), ["document_id"]).count() == 0


PHRASES = {
    "en": "the river will rise again during the night|people should stay in their houses|the council has closed the main road|a new map of the area was published|the storm moved slowly towards the coast",
    "de": "der fluss wird in der nacht wieder steigen|die menschen sollen in ihren häusern bleiben|die gemeinde hat die hauptstraße gesperrt|eine neue karte des gebiets wurde veröffentlicht|der sturm zog langsam auf die küste zu",
    "fr": "la rivière va encore monter pendant la nuit|les habitants doivent rester dans leurs maisons|la commune a fermé la route principale|une nouvelle carte de la zone a été publiée|la tempête avançait lentement vers la côte",
}


def say(lang, n, rng):
    return " ".join(" ".join(rng.choice(PHRASES[lang].split("|")) for _ in range(2)).capitalize() + "." for _ in range(n))


def test_languages(spark):
    rng = random.Random(4)
    train = [(1000 + i, lang if i % 9 else "en", say(lang, 4, rng)) for i, lang in enumerate(list(PHRASES) * 40)]  # some labels wrong
    test = {1: ("en", say("en", 2, rng)), 2: ("fr", say("de", 2, rng)), 3: (None, say("fr", 3, rng)), 4: ("German", say("de", 1, rng)), 5: ("en-AU", say("en", 1, rng)), 7: ("en", None), 8: ("en", "  "), 9: ("it", "12 34; 5.6 %"), 10: ("und", "12 34"), 11: ("xx", say("en", 1, rng))}
    en, de = say("en", 2, rng), say("de", 2, rng)
    test[6] = ("en", f"{en}\n\n{de} {en}")
    df = spark.createDataFrame([*train, *[(k, *v) for k, v in test.items()]], "doc_id long, lang string, text string")
    got = {tuple(r) for r in language.found_languages(df).where("doc_id < 1000").collect()}
    assert got == {(2, 0, "de"), (3, 0, "fr"), (6, 0, "en"), (6, len(en) + 2, "de"), (6, len(en) + 3 + len(de), "en"), (9, 0, "und"), (11, 0, "en")}
    held = {i: lang for i, lang in enumerate(list(PHRASES) * 20)}
    docs = spark.createDataFrame([(i, "xx", say(lang, 1, rng)) for i, lang in held.items()], "doc_id long, lang string, text string")
    model = language.fit(language.sample_labelled(df))
    out = language.language_segments(docs, ["doc_id"], model=model).collect()
    assert sum(held[r["doc_id"]] == r["lang"] for r in out) >= 0.95 * len(held) and all(0 <= r["confidence"] <= 1 for r in out)
    assert language.found_languages(df.limit(0)).count() == 0


def test_automaton_accepts_exactly_the_substrings():
    s = "abcbcabb"
    t = language.suffix_automaton(s)
    subs = {s[i:j] for i in range(len(s)) for j in range(i, len(s) + 1)}
    for a in "abc":
        for b in ["", *"abc"]:
            for c in ["", *"abc"]:
                w, state = a + b + c, 0
                for ch in w:
                    state = t[state].get(ch, -1) if state >= 0 else -1
                assert (state >= 0) == (w in subs)


def test_votes_alone_find_most_furniture(spark):
    """With the word lists off, consensus keeps over nine tenths of the lines and hardly an article line is lost."""
    from tesseral.llm.queries import _pages

    pages, keys = _pages(spark, "/root/testdata/sf0.1"), ["tbl", "document_id"]
    full = {tuple(r) for r in boilerplate.furniture_lines(pages, keys).collect()}
    votes = {tuple(r) for r in boilerplate.furniture_lines(pages, keys, prior=False).collect()}
    assert len(full & votes) > 0.9 * len(full)
    assert len(full & votes) > 0.99 * len(votes)


def test_standing_note_and_syndicated_article(spark):
    """A paragraph under many titles of a host is a note; the same article on many hosts stays an article."""
    note = "This paper is made by a small team of editors. It is printed twice a week in the old mill."
    story = "The river rose by two metres during the night. Crews closed the bridge before sunrise."
    titles = ["Bridge closed after flood", "Mayor opens new school", "Farmers fear dry summer", "Ferry runs aground again", "Museum finds lost map", "Power fails in harbour"]
    rows = [(f"n{i}", "a.example", "A", titles[i], f"{titles[i]}\nEvent {i} was seen by Mr {chr(65 + i)}ole. It was long and {'very ' * i}loud.\n{note}") for i in range(6)]
    rows += [(f"s{i}", f"h{i}.example", "B", "River rises over the bridge", f"River rises over the bridge\n{story}\nThe water fell again. Nobody was hurt there.") for i in range(8)]
    df = spark.createDataFrame(rows, "document_id string, host string, site string, title string, content string")
    got = {tuple(r) for r in boilerplate.furniture_lines(df, ["document_id"], prior=False).collect()}
    assert got == {(f"n{i}", 2) for i in range(6)}


def test_short_family_names_stay_apart(spark):
    """Kim, Lee, Li and Wu are four people; each one's own spellings are linked."""
    rows, i = [], 0
    for family in ("Kim", "Lee", "Li", "Wu"):
        for text in ("Yuna " + family, f"{family}, Yuna", f"Dr Yuna {family}"):
            i += 1
            rows.append((i, "person", text))
    df = spark.createDataFrame(rows, "id long, kind string, text string")
    want = {(a, b) for k in range(0, 12, 3) for a in range(k + 1, k + 4) for b in range(a + 1, k + 4)}
    for hot in (10_000, 1):
        assert {tuple(r) for r in names.linked_pairs(df, hot).collect()} == want
    members = names.name_members(df).collect()
    assert len(members) == 12 and len({r["entity"] for r in members}) == 4 and {r["links"] for r in members} == {2}


def test_unspaced_scripts():
    """Chinese, Japanese and Korean are told apart, whole unspaced sentences counted."""
    said = {
        "zh": "河水今晚还会继续上涨。居民应当留在家中等待通知。市政府已经关闭了主要道路。受影响地区的新地图已经公布。暴风雨正缓慢地向海岸移动。",
        "ja": "川の水は今夜さらに上がる見込みです。住民は家にとどまってください。市は主要道路を閉鎖しました。被害地域の新しい地図が公開されました。嵐はゆっくりと海岸へ向かっています。",
        "ko": "강물은 오늘 밤 다시 불어날 것입니다. 주민들은 집에 머물러야 합니다. 시는 주요 도로를 폐쇄했습니다. 피해 지역의 새 지도가 공개되었습니다. 폭풍은 천천히 해안으로 이동하고 있습니다.",
    }
    model = language.Model({k: language.alphabet_only(v) for k, v in said.items()})
    for lang, text in said.items():
        assert language.alphabet_only(text)
        assert {x[2] for x in language.label_texts([text], model)[0]} == {lang}
    assert {x[2] for x in language.label_texts(["市政府今晚公布了通知。居民已经等待暴风雨。"], model)[0]} == {"zh"}
    assert {x[2] for x in language.label_texts(["시는 오늘 밤 지도를 공개했습니다"], model)[0]} == {"ko"}
    long = "donaudampfschifffahrtsgesellschaftskapitän"
    assert language.alphabet_only(long) == long


def test_index_prunes_and_loses_nothing(spark):
    """Of the values of mentions whose id is divisible by 20, the index finds what scoring all entries finds."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    ref = spark.read.parquet(f"{d}/category_ref.parquet")
    names = F.explode(F.array_union(F.array("category"), F.coalesce("aliases", F.array().cast("array<string>"))))
    entries = ref.select(F.col("dimension_name").alias("grp"), F.col("category_id").alias("entry_id"), names.alias("name"))
    m = spark.read.parquet(f"{d}/mentions.parquet").where("mention_id % 20 = 0 and category is not null")
    values = m.select(F.col("dimension_name").alias("grp"), F.col("category").alias("value")).distinct()
    key = lambda df: {(r["grp"], r["value"], r["entry_id"]) for r in df.collect()}
    some, every = key(canonical.match_values(values, entries)), key(canonical.match_values(values, entries, recall=0.0))
    assert len(some & every) >= 0.995 * len(every)
