"""Languages of documents and of their mixed segments (problem 9).

Method: cross-parsing entropy.  For each language a suffix automaton of labelled text accepts exactly the
substrings of that text.  A text is parsed against each automaton into longest matches, each phrase running until
the automaton has no continuation; the language that needs the fewest phrases a character wins.  Documents are
cut into sentences, all sentences of a batch are parsed against all automata in step (one array operation a
character), and a shortest path over each document's sentences, with a price on changes of language, gives its
segments.

The automata are fitted on a bounded sample of labelled rows: at most SAMPLE_DOCS documents of each language, of
each at most SAMPLE_CHARS characters, TRAIN_CHARS a language in all.  Labels being wrong at times, the sample is
cleaned first: each half is parsed against automata of the other, and sentences that another language explains
better are left out.  All rows and whole texts are then labelled.

Defined results: null and blank texts have no segment; a text without words is one segment "und"; numbers, codes,
signs and quoted scraps take the language around them; without any labelled row all languages are "und".
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.session import shared_dir

SAMPLE_DOCS, SAMPLE_CHARS, TRAIN_CHARS = 150, 1500, 24_000
SWITCH = 3.0  # phrases a change of language must save
MIN_RUN = 40  # shorter runs inside another language don't count
BATCH_CHARS = 2_000_000
# ISO 639-1, ISO 639-2 and English names of languages.
NAMES = """en eng english|de deu ger german|fr fra fre french|es spa spanish|pt por portuguese|nl nld dut dutch|it ita italian|pl pol polish|ru rus russian|sv swe swedish|da dan danish|no nor norwegian|fi fin finnish|cs ces cze czech|
sk slk slo slovak|hu hun hungarian|ro ron rum romanian|el ell gre greek|tr tur turkish|uk ukr ukrainian|bg bul bulgarian|hr hrv croatian|sr srp serbian|sl slv slovenian|et est estonian|lv lav latvian|lt lit lithuanian|ja jpn japanese|zh zho chi chinese|
ko kor korean|ar ara arabic|he heb hebrew|hi hin hindi|vi vie vietnamese|id ind indonesian|ca cat catalan|und und undetermined"""
CODES = {n: line.split()[0] for line in NAMES.replace("\n", "").split("|") for n in line.split()}


def label_code(label: str | None) -> str | None:
    """The two-letter code a label names, or None."""
    if not isinstance(label, str):
        return None
    s = label.strip().lower()
    return CODES.get(s) or CODES.get(m[1] if (m := re.fullmatch(r"([a-z]{2,3})[-_][a-z0-9]{2,4}(?:[-_][a-z0-9]+)*", s)) else "")


_INVISIBLE = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufe00-\\ufe0f\\ufeff]")
_CODE = re.compile(r"[\d+=_|<>@#/\\]")
_CODED = re.compile(r"(?<!\S)[^\s\d+=_|<>@#/\\]*[\d+=_|<>@#/\\]\S*")  # a word with a digit or other code sign in it
_OTHER = re.compile(r"\W+")
_HANGUL = re.compile("[\\uac00-\\ud7a3]+")


def alphabet_only(s: str) -> str:
    """Letters in lower case and single blanks, Korean syllables as their letters; words with digits or other code signs in them are left out."""
    if not s.isascii():
        s = _INVISIBLE.sub("", unicodedata.normalize("NFC", s))
    s = s.lower()
    if _CODE.search(s):
        s = _CODED.sub(" ", s)
    s = _OTHER.sub(" ", s).strip()
    return s if s.isascii() or not _HANGUL.search(s) else _HANGUL.sub(lambda m: unicodedata.normalize("NFD", m[0]), s)


_SENTENCE = re.compile(r"[.!?…]+[\"'”’»«)\]]*\s+|[。！？]+[」』”’）\"')\]]*\s*|[^\S\n]*\n\s*|\s{2,}|\t")
_WORD = re.compile(r"[^\W\d_]{3,}")
_CJK = re.compile("[\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af]")


def units(text: str) -> list[tuple[int, int]]:
    """Sentences and lines as [start, end)."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def suffix_automaton(s: str) -> list[dict[str, int]]:
    """Transitions of the smallest automaton that accepts all substrings of s; state 0 is the start."""
    nexts: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


class Model:
    """The automata of all languages as one flat transition table.

    A state is the place of its row in the table, so a step is one sum and one look-up.  Each row ends in a column
    for signs the language doesn't have; -1 is no transition.
    """

    TOP = 0x3100  # code points from here on (Han and other large scripts) are signs by blocks of 64

    @classmethod
    def signs(cls, text: str) -> np.ndarray:
        """The sign of each character: its code point, or its block's number behind TOP."""
        flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(flat < cls.TOP, flat, cls.TOP + (flat >> 6))

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        said = {lang: "".join(map(chr, self.signs(t).tolist())) for lang, t in texts.items()}
        chars = sorted({c for t in said.values() for c in t})
        self.codes = np.zeros(self.TOP + (0x110000 >> 6), np.int16)  # 0: a sign that no language has
        for i, c in enumerate(chars):
            self.codes[ord(c)] = i + 1
        k = len(self.langs)
        self.local = np.zeros((k, len(chars) + 1), np.int32)
        self.root = np.zeros((k, len(chars) + 1), np.int32)  # the state after a first sign; the start where there is none
        self.start = np.zeros(k, np.int32)
        tables, at = [], 0
        for row, lang in enumerate(self.langs):
            own = sorted(set(said[lang]))
            ids, width = {c: i for i, c in enumerate(own)}, len(own) + 1
            nexts = suffix_automaton(said[lang])
            t = np.full((len(nexts), width), -1, np.int32)
            for state, n in enumerate(nexts):
                for c, to in n.items():
                    t[state, ids[c]] = at + to * width
            self.start[row], self.local[row], self.root[row] = at, width - 1, at
            for c, i in ids.items():
                code = self.codes[ord(c)]
                self.local[row, code] = i
                self.root[row, code] = t[0, i]
            tables.append(t.ravel())
            at += t.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """The number of phrases of each text in each language, all parsed in step."""
        n, k = len(texts), len(self.langs)
        out = np.zeros((n, k))
        if not n or not k:
            return out
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        step = 2000
        for a in range(0, n, step):
            part, ls = order[a : a + step], lengths[a : a + step]
            longest = int(ls[0])
            if not longest:
                break
            codes = np.zeros((longest, len(part)), np.int16)  # a row for each position
            flat = self.codes[self.signs("".join(texts[i] for i in part))]
            column = np.repeat(np.arange(len(part)), ls)
            codes[np.arange(len(flat)) - np.repeat(np.cumsum(ls) - ls, ls), column] = flat
            active = np.searchsorted(-ls, -np.arange(longest), "left")  # texts longer than the position
            counts = np.zeros((k, len(part)), np.int32)
            states = np.repeat(self.start[:, None], len(part), axis=1)
            for pos in range(longest):
                m = active[pos]
                code = codes[pos, :m]
                now = states[:, :m]
                to = self.table.take(now + self.local.take(code, axis=1))
                ended = to < 0
                counts[:, :m] += ended
                states[:, :m] = np.where(ended, self.root.take(code, axis=1), to)
            out[part] = (counts + (states != self.start[:, None])).T
        return out


def fit(sample: list[tuple[str, str]]) -> Model:
    """A model of (language, text) rows, cleaned of sentences that other languages explain better."""
    return Model(training_texts(sample))


def training_texts(sample: list[tuple[str, str]]) -> dict[str, str]:
    """The text of each language that its automaton accepts, from (language, text) rows."""
    halves: list[dict[str, list[str]]] = [defaultdict(list), defaultdict(list)]
    for i, (lang, text) in enumerate(sample):
        for a, b in units(text):
            s = alphabet_only(text[a:b])
            if len(s) >= 20:
                halves[i % 2][lang].append(s)
    joined = lambda h: {lang: " ".join(dict.fromkeys(ss))[:TRAIN_CHARS] for lang, ss in h.items()}
    for share in (1.0, 0.85, 0.7):  # at first a mislabelled share is in all automata, so the demand rises by round
        clean: list[dict[str, list[str]]] = [defaultdict(list), defaultdict(list)]
        for at in (0, 1):
            model = Model(joined(halves[1 - at]))
            for lang, ss in halves[at].items():
                if lang not in model.langs:
                    clean[at][lang] += ss
                    continue
                cost = model.phrases(ss)
                own = cost[:, model.langs.index(lang)]
                rest = np.delete(cost, model.langs.index(lang), axis=1)
                keep = own < share * rest.min(axis=1) if rest.shape[1] else np.ones(len(ss), bool)
                clean[at][lang] += [s for s, ok in zip(ss, keep) if ok]
        halves = clean
    both: dict[str, list[str]] = defaultdict(list)
    for h in halves:
        for lang, ss in h.items():
            both[lang] += ss
    return joined({lang: ss for lang, ss in both.items() if ss})


def _is_sign(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk", "Cf", "Mn", "Cc") or c.isspace()


def _segments(text: str, spans: list[tuple[int, int]], cost: np.ndarray, worded: list[bool], langs: list[str]):
    """The cheapest path over the sentences: (start, end, language, confidence) of each run."""
    n, k = cost.shape
    said = cost[cost.any(axis=1)]
    if not len(said):  # codes only
        return [(len(text) - len(text.lstrip()), len(text), "und", 1.0)]
    if (said.argmin(axis=1) == said[0].argmin()).all():  # one language wins every sentence
        start, sums = len(text) - len(text.lstrip()), np.sort(cost.sum(axis=0))
        sure = 1.0 if k == 1 else float(1 - sums[0] / max(sums[1], 1e-9))
        return [(start, len(text), langs[int(cost.sum(axis=0).argmin())], round(max(0.0, sure), 4))]
    total, back = cost[0].copy(), np.zeros((n, k), np.int32)
    for i in range(1, n):
        best = int(total.argmin())
        stay = total <= total[best] + SWITCH
        back[i] = np.where(stay, np.arange(k), best)
        total = np.where(stay, total, total[best] + SWITCH) + cost[i]
    path = np.zeros(n, np.int32)
    path[-1] = total.argmin()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    # sentences without words go with what is before them
    runs: list[list] = []
    for i in range(n):
        if runs and (runs[-1][2] == path[i] or not worded[i]):
            runs[-1][1] = i
        else:
            runs.append([i, i, path[i]])
    size = lambda r: len(text[spans[r[0]][0] : spans[r[1]][1]].strip())
    while len(runs) > 1:  # short runs join the neighbour they lean on
        r = min(range(len(runs)), key=lambda x: size(runs[x]))
        if size(runs[r]) >= MIN_RUN:
            break
        if r:
            runs[r - 1][1] = runs[r][1]
        else:
            runs[1][0] = runs[0][0]
        del runs[r]
        merged = [runs[0]]
        for x in runs[1:]:
            if x[2] == merged[-1][2]:
                merged[-1][1] = x[1]
            else:
                merged.append(x)
        runs = merged
    out = []
    for x, (a, b, lang) in enumerate(runs):
        start = spans[a][0] if x else 0
        while start < len(text) - 1 and (_is_sign(text[start]) if x else text[start].isspace()):
            start += 1
        sums = np.sort(cost[a : b + 1].sum(axis=0))
        sure = 1.0 if k == 1 else float(1 - sums[0] / max(sums[1], 1e-9))
        out.append((start, langs[lang], round(max(0.0, sure), 4)))
    ends = [s for s, _, _ in out[1:]] + [len(text)]
    return [(s, e, lang, c) for (s, lang, c), e in zip(out, ends)]


def label_texts(texts: list[str | None], model: Model) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, language, confidence) of the segments of each text."""
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    plan, known, seen, distinct = [], {}, {}, []
    for i, t in enumerate(texts):
        if not isinstance(t, str) or not t.strip():
            continue
        if not (_WORD.search(t) or _CJK.search(t)) or not model.langs:
            start = len(t) - len(t.lstrip())
            out[i] = [(start, len(t), "und", 1.0)]
            continue
        spans = units(t)
        rows = []
        for a, b in spans:
            raw = t[a:b]
            at = known.get(raw)
            if at is None:
                s = alphabet_only(raw)
                if s not in seen:
                    seen[s] = len(distinct)
                    distinct.append(s)
                at = known[raw] = seen[s]
            rows.append(at)
        plan.append((i, spans, rows))
    costs = model.phrases(distinct)
    worded = [len(s) >= 4 for s in distinct]
    for i, spans, rows in plan:
        out[i] = _segments(texts[i], spans, costs[rows], [worded[r] for r in rows], model.langs)
    return out


def sample_labelled(docs: DataFrame, text: str = "text", label: str = "lang") -> list[tuple[str, str]]:
    """The bounded sample (language, text) of labelled rows, chosen by hash, alike at every run."""
    table = docs.sparkSession.createDataFrame(sorted(CODES.items()), "said string, code string")
    said = F.regexp_replace(F.lower(F.trim(F.col(label))), r"^([a-z]{2,3})[-_][a-z0-9]{2,4}.*$", "$1")
    rows = docs.where((F.char_length(F.col(text)) >= 60) & F.col(label).isNotNull()).select(said.alias("said"), F.col(text).alias("t"))
    rows = rows.join(F.broadcast(table.where("code <> 'und'")), "said").select("code", F.substring("t", 1, SAMPLE_CHARS).alias("t")).withColumn("h", F.xxhash64("t"))
    counts = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return []
    share = F.coalesce(*[F.when(F.col("code") == c, F.lit(min(1.0, 3 * SAMPLE_DOCS / n))) for c, n in sorted(counts.items())])
    chosen = rows.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).dropDuplicates(["code", "t"])
    got: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in chosen.select("code", "h", "t").collect():  # about three times the sample at most
        got[r["code"]].append((r["h"], r["t"]))
    return [(c, t) for c in sorted(got) for _, t in sorted(got[c])[:SAMPLE_DOCS]]


def fitted(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """The model of a table's labelled rows; its cleaned texts are kept in the shared folder under the sample's hash."""
    sample, spark = sample_labelled(docs, text, label), docs.sparkSession
    said = repr((TRAIN_CHARS, SAMPLE_CHARS, sample)).encode("utf-8", "surrogatepass")
    path = f"{shared_dir(spark).rstrip('/')}/models/language-{hashlib.sha256(said).hexdigest()}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        texts = training_texts(sample)
        spark.createDataFrame(sorted(texts.items()), "lang string, text string").coalesce(1).write.mode("overwrite").parquet(path)
        return Model(texts)
    return Model({r["lang"]: r["text"] for r in spark.read.schema("lang string, text string").parquet(path).collect()})  # a row a language, TRAIN_CHARS each


SEGMENTS = "start_char long, end_char long, lang string, confidence double, position int, segments int"


def language_segments(docs: DataFrame, keys: list[str], text: str = "text", label: str = "lang", model: Model | None = None) -> DataFrame:
    """keys, said (the label), start_char, end_char, lang, confidence, position, segments: a row for each segment of each text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model or fitted(docs, text, label))
    rows = docs.select(*keys, F.col(label).alias("said"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, "said").schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["__text"].str.len().cumsum() // BATCH_CHARS
            for _, part in b.groupby(size, sort=False):
                found = label_texts(part["__text"].tolist(), sent.value)
                at = np.repeat(np.arange(len(part)), [len(f) for f in found])
                out = part[[*keys, "said"]].iloc[at].reset_index(drop=True)
                flat = [(*s, p, len(f)) for f in found for p, s in enumerate(f)]
                cols = ["start_char", "end_char", "lang", "confidence", "position", "segments"]
                yield pd.concat([out, pd.DataFrame(flat, columns=cols)], axis=1) if flat else out.assign(**{c: [] for c in cols})

    return rows.mapInPandas(run, f"{schema}, {SEGMENTS}")


def found_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_char, lang) for texts whose label is missing or wrong or that have more than one language."""
    spark = docs.sparkSession
    seg = language_segments(docs, ["doc_id"])
    table = F.broadcast(spark.createDataFrame(sorted(CODES.items()), "key string, code string"))
    key = F.regexp_replace(F.lower(F.trim("said")), r"^([a-z]{2,3})[-_][a-z0-9]{2,4}([-_][a-z0-9]+)*$", "$1")
    seg = seg.withColumn("key", key).join(table, "key", "left")
    case = (F.col("segments") > 1) | F.col("code").isNull() | (F.col("code") != F.col("lang"))
    return seg.where(case).select("doc_id", "start_char", "lang")
