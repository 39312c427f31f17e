"""Subject areas of documents by seeded latent Dirichlet topic models.

For each language one topic model is fitted over all documents: one topic for
each subject and some background topics. It is latent Dirichlet allocation by
variational expectation maximisation with an informative prior: the labelled
examples (and, for terms a language's examples lack, cognates in the other
languages' examples) give every subject topic its first top terms, which is how
topics are mapped to subjects; terms that examples or documents show spread over subjects are
left to the background. Each iteration is one distributed pass that returns the
expected counts per term, summed by a shuffle; only the topic-term table, whose
size the vocabulary bounds, is on the driver. A document is about the subjects
that hold enough of its subject tokens.

Code blocks, links and paths don't count, nor do sentences that only name something in
passing or for comparison. Such sentences are known by their wording, which is learned from the labelled examples: three
words in a row that stand, again and again and with different subjects, where an example speaks of what it is not about.
Null and empty texts have no subjects. Repeated texts have the same subjects. Extra columns are ignored.

Words are runs of letters of any script. The most frequent terms of a language have a row of the topic table each; beyond
its bound terms share rows by hash, so that every term counts and the table doesn't grow with the corpus. A text
without function words of the four languages is read by the model that knows most of its terms.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import spread, store

#: Labelled examples used at most, and the least number of documents of a term.
EXAMPLES, LEAST_DOCS = 20_000, 3
#: Rows of a language's topic table for single terms (the most frequent), and rows that terms beyond those share.
TABLE, SHARED = 200_000, 1 << 14
BACKGROUND, ITERATIONS, INNER = 4, 10, 6
#: Fitting ends when the topics have moved by less than this share of their mass in a turn.
SETTLED = 0.01
ALPHA_SUBJECT, ALPHA_BACKGROUND, ETA, STRENGTH, COGNATE = 0.1, 0.3, 0.01, 5.0, 0.3
#: A wording marks passing mentions if it stands in this many sentences off an example's subjects, of this many subjects, and if this share of its sentences is off.
LEAST_OFF, LEAST_SUBJECTS, OFF_SHARE = 4, 3, 0.75
#: A subject needs this many tokens of a document, and this share of its subject tokens.
LEAST_TOKENS, LEAST_SHARE = 3.0, 0.13

#: Frequent words that tell four languages apart.
FUNCTION_WORDS = {
    "en": "the of and is to for was by in are this when each than it that were no yesterday every must between",
    "de": "der die das und ist nicht nichts wird mit den dem zu von am ohne diese dieser jede zum auf einem ein eine im gegen neben vor mehr",
    "es": "el los las y con no por una al sin este esta cada del ya se antes ahora junto que es su mantiene entre al",
    "fr": "le les et des est une dans pour du avec plus on sans chaque ce aux à désormais avant sur pas au côté reste rien qui",
}
_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_PLACE = re.compile(r"https?://\S+|\S*[/\\]\S*|\S+:\d+(?::\d+)?\b|^\s*\[\w+\]|&\w+;|\b[\w.]+\.(?:py|rs|ts|js|go|java|md|txt|toml|json|ya?ml)\b")
_WORD = re.compile(r"[^\W\d_]+")
_WRAPPED = re.compile(r"(?<=[^\s.!?:])[ \t]*\n[ \t]*(?=[^\s#>*|\[\]{}+=-])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[.!?]\))\s+")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])")


@lru_cache(maxsize=200_000)
def singular(word: str) -> str:
    word = word.lower()
    while len(word) > 3 and word.endswith("s"):
        word = word[:-2] if re.search("(?:s|x|z|ch|sh)es$", word) and len(word) > 4 else word[:-1]
    return word


_MARKS = {lang: {singular(w) for w in text.split()} for lang, text in FUNCTION_WORDS.items()}
_SHARED = {w for w, n in Counter(w for v in _MARKS.values() for w in v).items() if n > 1}
LANGUAGES = tuple(_MARKS)


#: Without one of these no place is named: most sentences are spared the pattern.
_PLACE_HINT = re.compile(r"[/\\\[&]|:\d|\.[a-z]")


def sentences(text: str) -> list[str]:
    text = unicodedata.normalize("NFC", text.replace("\r", "\n"))
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    text = _WRAPPED.sub(" ", text)
    return [s for line in text.split("\n") if line for s in _SENTENCE.split(line) if s and not s.isspace()]


def _plain(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def terms(text: str | None, markers: frozenset[str] = frozenset()) -> Counter:
    """Words and pairs of neighbouring words of a text, without sentences that hold one of ``markers`` (see ``passing_markers``)."""
    if not text:
        return Counter()
    found: list[str] = []
    if markers:
        whole = f" {_plain(text)} "
        markers = [m for m in markers if m in whole]
    for s in sentences(text):
        if markers and _holds(f" {_plain(s)} ", markers):
            continue
        found += sentence_terms(s)
    return Counter(found)


def _holds(plain: str, markers) -> bool:
    return any(m in plain for m in markers)


def sentence_terms(sentence: str) -> list[str]:
    if _PLACE_HINT.search(sentence):
        sentence = _PLACE.sub(" ", sentence)
    words = [singular(w) for w in _WORD.findall(_CAMEL.sub(" ", sentence))]
    return [w for w in words if len(w) > 1] + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def passing_markers(examples: list[tuple[str, list[int]]], subjects: int) -> frozenset[str]:
    """Three words in a row by which sentences are known that mention a subject only in passing, learned from labelled texts.

    A sentence is off its text's subjects if the terms in it that tell a subject all tell others than the labelled ones.
    """
    split = [([(s, sentence_terms(s)) for s in sentences(text)], labels) for text, labels in examples]
    n, weight = {}, np.zeros(subjects)
    for parts, labels in split:
        weight[labels] += 1 / len(labels)
        for w in {w for _, found in parts for w in found}:
            n.setdefault(w, np.zeros(subjects))[labels] += 1 / len(labels)
    pi = (weight + 0.5) / (weight.sum() + 0.5 * subjects)
    tells = {}
    for w, count in n.items():
        p = (count + pi) / (count.sum() + 1)
        if count.sum() >= 2 and p.max() > 0.5 and (p / pi).argmax() == p.argmax():
            tells[w] = int(p.argmax())
    off, on, of = Counter(), Counter(), {}
    for parts, labels in split:
        for s, found in parts:
            told = {tells[w] for w in found if w in tells}
            words = _plain(s).split(" ")
            for m in {" ".join(words[k : k + 3]) for k in range(len(words) - 2)}:
                if told and not told & set(labels):
                    off[m] += 1
                    of.setdefault(m, set()).update(told)
                elif told:
                    on[m] += 1
    return frozenset(f" {m} " for m, k in off.items() if k >= LEAST_OFF and len(of[m]) >= LEAST_SUBJECTS and k >= OFF_SHARE * (k + on[m]))


def language(found: Counter) -> str | None:
    votes = {lang: sum(n for w, n in found.items() if w in marks and w not in _SHARED) for lang, marks in _MARKS.items()}
    best = max(votes, key=votes.get)
    return best if votes[best] else None


def cognate(term: str) -> str | None:
    """What related words of several languages have in common: the first letters without marks and doubling."""
    if " " in term:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c))
    plain = re.sub(r"(.)\1", r"\1", plain.replace("ph", "f").replace("y", "i").replace("k", "c").replace("th", "t"))
    return plain[:5] if len(plain) >= 5 else (plain if len(plain) == 4 else None)


@dataclass
class Model:
    """A language's topic model: term ids, and the probability of each term in each topic (subjects first)."""

    index: dict
    topics: np.ndarray
    prior: np.ndarray
    blocked: np.ndarray


def csr(docs: list[dict], index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ptr, col, val = [0], [], []
    for d in docs:
        for w, n in d.items():
            if (k := index.get(w)) is not None:
                col.append(k)
                val.append(n)
        ptr.append(len(col))
    return np.asarray(ptr), np.asarray(col, dtype=np.int64), np.asarray(val, dtype=float)


#: Documents that inference handles at once: their table stays in the processor's cache.
CHUNK = 128


def expected(topics: np.ndarray, table, subjects: int, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expected topic counts of each (document, term) entry, and of each document: variational inference with the topics fixed."""
    ptr, col, val = table
    n, k = len(ptr) - 1, topics.shape[1]
    alpha = np.asarray([ALPHA_SUBJECT] * subjects + [ALPHA_BACKGROUND] * (k - subjects), dtype=topics.dtype)
    each, counts = np.zeros((len(col), k), topics.dtype), np.zeros((n, k), topics.dtype)
    full = np.flatnonzero(np.diff(ptr) > 0)
    for at in range(0, len(full), CHUNK):
        docs = full[at : at + CHUNK]
        start, size = ptr[docs], ptr[docs + 1] - ptr[docs]
        first, last = start[0], ptr[docs[-1] + 1]  # documents without terms in between have no entries
        row = np.repeat(np.arange(len(docs)), size)
        p = topics[col[first:last]]
        if mask is not None:
            p *= mask[docs].astype(topics.dtype)[row]
        v, begin = val[first:last].astype(topics.dtype), start - first
        share = np.tile(alpha / alpha.sum(), (len(docs), 1))
        for _ in range(INNER):
            weight = v / (np.einsum("ij,ij->i", p, share[row]) + topics.dtype.type(1e-30))
            own = share * np.add.reduceat(p * weight[:, None], begin, axis=0)
            last_share, share = share, own + alpha
            share /= share.sum(axis=1, keepdims=True)
        counts[docs] = own
        each[first:last] = p * last_share[row] * weight[:, None]
    return each, counts


def statistics(model: Model, table, subjects: int, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts per term and topic, and per term the documents' shares of each subject."""
    ptr, col, _ = table
    each, counts = expected(model.topics, table, subjects, mask)
    v = len(model.topics)
    topic = np.stack([np.bincount(col, each[:, k], v) for k in range(each.shape[1])], axis=1)
    own = counts[:, :subjects]
    own = own / np.maximum(own.sum(axis=1, keepdims=True), 1.0)
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    spread = np.stack([np.bincount(col, own[row, k], v) for k in range(subjects)], axis=1)
    return topic, spread


def seeded(freq: dict[str, int], examples: list[tuple[dict, list[int]]], keys: dict[str, np.ndarray], subjects: int) -> Model:
    """The first model of a language from its term frequencies and labelled examples; ``keys`` has the cognates' subjects."""
    index = {w: k for k, w in enumerate(freq)}
    v, k = len(index), subjects + BACKGROUND
    n, weight = np.zeros((v, subjects)), np.zeros(subjects)
    for found, labels in examples:
        for s in labels:
            weight[s] += 1 / len(labels)
        at = [index[w] for w in found if w in index]
        for s in labels:
            n[at, s] += 1 / len(labels)
    pi = (weight + 0.5) / (weight.sum() + 0.5 * subjects)
    seen = n.sum(axis=1)
    p = (n + pi) / (seen + 1)[:, None]
    lift = p / pi
    seed = n * np.log(np.maximum(lift, 1)) * (lift == lift.max(axis=1, keepdims=True)) * (p > 0.4)
    for w, at in index.items():
        if seen[at] < 1 and (key := cognate(w)) and (q := keys.get(key)) is not None:
            seed[at] = COGNATE * q
    f = np.asarray(list(freq.values()), dtype=float)
    blocked = ((seen >= 4) & (p.max(axis=1) < 0.5) & (lift.max(axis=1) < 4)) | (f > 0.2 * max(f.max(initial=0), 10))
    prior = np.full((v, k), ETA)
    prior[:, :subjects] += STRENGTH * seed
    prior[blocked, :subjects] = 0
    topics = prior.copy()
    rare = 0.02 * f / max(f.mean(), 1e-9) if v else f
    topics[:, :subjects] += rare[:, None] * ~blocked[:, None]
    noise = np.random.default_rng(0).uniform(0.5, 1.5, (v, BACKGROUND))
    topics[:, subjects:] += np.where(blocked, f, 10 * rare)[:, None] * noise
    model = Model(index, topics, prior, blocked)
    return _normalised(model, topics, subjects)


def _normalised(model: Model, counts: np.ndarray, subjects: int) -> Model:
    counts = counts + 1e-12
    counts[model.blocked, :subjects] = 1e-12
    return Model(model.index, counts / counts.sum(axis=0), model.prior, model.blocked)


def updated(model: Model, topic: np.ndarray, spread: np.ndarray, docs: np.ndarray, subjects: int, check: bool) -> Model:
    """The next model; with ``check``, terms of many documents of different subjects are left to the background."""
    blocked = model.blocked
    if check:
        share = spread / np.maximum(spread.sum(axis=1, keepdims=True), 1e-9)
        blocked = blocked | ((docs >= 10) & (spread.sum(axis=1) >= 5) & (share.max(axis=1) < 0.45))
    return _normalised(Model(model.index, model.topics, model.prior, blocked), topic + model.prior, subjects)


def cognate_keys(examples: list[tuple[dict, list[int]]], subjects: int) -> dict[str, np.ndarray]:
    """Subjects of word beginnings over the examples of all languages, where one subject holds most."""
    counts: dict[str, np.ndarray] = {}
    weight = np.zeros(subjects)
    for found, labels in examples:
        for s in labels:
            weight[s] += 1 / len(labels)
        for key in {c for w in found if (c := cognate(w))}:
            at = counts.setdefault(key, np.zeros(subjects))
            for s in labels:
                at[s] += 1 / len(labels)
    pi = (weight + 0.5) / (weight.sum() + 0.5 * subjects)
    out = {}
    for key, n in counts.items():
        p = (n + pi) / (n.sum() + 1)
        if p.max() > 0.6:
            s = int(p.argmax())
            out[key] = np.eye(subjects)[s] * min(n[s], 5.0) * np.log(p[s] / pi[s])
    return out


def assign(counts: np.ndarray, subjects: int) -> np.ndarray:
    """Which subjects hold enough of each document's subject tokens."""
    own = counts[:, :subjects]
    return (own >= LEAST_TOKENS) & (own >= LEAST_SHARE * own.sum(axis=1, keepdims=True))


FEATURES = "doc bigint, lang string, terms array<string>, counts array<int>"


def features(docs: DataFrame, markers: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id, lang, terms, counts of every document with terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = []
                for doc, text in zip(batch["doc_id"].iloc[at : at + 1000], batch["text"].iloc[at : at + 1000], strict=True):
                    if found := terms(text, markers):
                        rows.append((doc, language(found), list(found), list(found.values())))
                yield pd.DataFrame(rows, columns=["doc", "lang", "terms", "counts"])

    return spread(docs.where("text is not null and doc_id is not null").select("doc_id", "text")).mapInPandas(run, FEATURES)


@dataclass
class Fitted:
    names: list[str]
    models: dict[str, Model]

    def top_terms(self, lang: str, count: int = 12) -> dict[str, list[str]]:
        """Each subject topic's most telling terms, for inspection."""
        m = self.models[lang]
        words = np.asarray(list(m.index), dtype=object)
        mean = m.topics.mean(axis=1, keepdims=True)
        score = m.topics * np.log(m.topics / mean)
        return {name: list(words[np.argsort(-score[:, k])[:count]]) for k, name in enumerate(self.names)}


ENCODED = "doc bigint, lang int, sure boolean, cols array<int>, vals array<float>"


def shared_row(term: str) -> int:
    """The shared row of a term that has none of its own."""
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % SHARED


def encoded(feats: DataFrame, indexes: dict[str, dict[str, int]], full: dict[str, bool]) -> DataFrame:
    """Features with term ids instead of terms. A text without function words gets the language that knows most of its terms.

    In languages whose table is ``full``, terms without a row take a shared one behind it; elsewhere they are in too few documents to be terms.
    """
    shared = feats.sparkSession.sparkContext.broadcast(indexes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = []
                part = batch.iloc[at : at + 1000]
                for doc, lang, found, counts in zip(part["doc"], part["lang"], part["terms"], part["counts"], strict=True):
                    sure = isinstance(lang, str)
                    lang = lang if sure else max(LANGUAGES, key=lambda x: sum(w in shared.value[x] for w in found))
                    index = shared.value[lang]
                    if full[lang]:
                        pairs = Counter()
                        for w, n in zip(found, counts, strict=True):
                            pairs[index[w] if w in index else len(index) + shared_row(w)] += n
                        pairs = list(pairs.items())
                    else:
                        pairs = [(k, n) for w, n in zip(found, counts, strict=True) if (k := index.get(w)) is not None]
                    rows.append((doc, LANGUAGES.index(lang), sure, [k for k, _ in pairs], [float(n) for _, n in pairs]))
                yield pd.DataFrame(rows, columns=["doc", "lang", "sure", "cols", "vals"])

    return feats.mapInPandas(run, ENCODED)


def tables(batch: pa.RecordBatch, rows: int = 2000):
    """(language, row numbers, csr table) of slices of an Arrow batch of encoded documents; no value becomes a Python object."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        lang = part.column("lang").to_numpy(zero_copy_only=False)
        cols, vals = part.column("cols"), part.column("vals")
        ends = cols.offsets.to_numpy()
        size = np.diff(ends)
        flat, count = cols.flatten().to_numpy(), vals.flatten().to_numpy()
        for k in np.unique(lang):
            mine = lang == k
            entry = np.repeat(mine, size)
            yield LANGUAGES[k], at + np.flatnonzero(mine), (np.concatenate([[0], np.cumsum(size[mine])]), flat[entry].astype(np.int64), count[entry])


@dataclass
class Labelled:
    """Subjects in order, and labelled texts (text, subject numbers) with the wordings of passing mentions learned from them."""

    names: list[str]
    texts: list[tuple[str, list[int]]]
    markers: frozenset[str]


def labelled(examples: DataFrame, areas: DataFrame) -> Labelled:
    """The examples with at least one known subject, at most EXAMPLES of them in the order of their ids. The subjects are a small table."""
    names = [r[0] for r in areas.where("subject is not null").select("subject").distinct().orderBy("subject").collect()]
    place = {s: k for k, s in enumerate(names)}
    texts = []
    for r in examples.where("text is not null").orderBy("example_id").select("text", "subjects").limit(EXAMPLES).collect():
        if labels := sorted({place[s] for s in r["subjects"] or [] if s in place}):
            texts.append((r["text"], labels))
    return Labelled(names, texts, passing_markers(texts, len(names)))


def fit(feats: DataFrame, known: Labelled) -> tuple[Fitted, DataFrame]:
    """Fit the models of all languages over stored features of all documents; the models and the encoded documents."""
    spark = feats.sparkSession
    subjects = len(known.names)
    read = [(language(found) or "en", dict(found), labels) for text, labels in known.texts if (found := terms(text, known.markers))]
    keys = cognate_keys([(f, y) for _, f, y in read], subjects)
    df = feats.where("lang is not null").select("lang", F.explode("terms").alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    df = store(df.where(F.col("n") >= LEAST_DOCS), "subject_vocabulary").df
    sizes = dict(df.groupBy("lang").agg(F.count("*")).collect())
    full = {x: sizes.get(x, 0) > TABLE for x in LANGUAGES}
    # a limit keeps the most frequent in the map stage; a window would bring a language's terms to one task
    words = pd.concat([df.where(F.col("lang") == x).orderBy(F.desc("n"), "term").limit(TABLE).toArrow().to_pandas() for x in LANGUAGES])
    models, own, indexes, docs_of = {}, {}, {}, {}
    for lang in LANGUAGES:
        part = words[words["lang"] == lang]
        freq = dict(zip(part["term"], part["n"], strict=True))
        mine = [(f, y) for x, f, y in read if x == lang]
        for w in {w for f, _ in mine for w in f}:
            freq.setdefault(w, 1)
        indexes[lang] = {w: k for k, w in enumerate(freq)}
        if full[lang]:
            beyond = Counter()
            rest = df.where(F.col("lang") == lang).join(F.broadcast(spark.createDataFrame(part[["term"]])), "term", "left_anti")
            row = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(SHARED)).cast("int")
            beyond.update(dict(rest.groupBy(row.alias("row")).agg(F.sum("n")).collect()))  # at most SHARED rows
            freq |= {f"\0{k}": max(beyond[k], 1) for k in range(SHARED)}
        models[lang] = seeded(freq, mine, keys, subjects)
        mask = np.zeros((len(mine), subjects + BACKGROUND))
        mask[:, subjects:] = 1
        for k, (_, y) in enumerate(mine):
            mask[k, y] = 1
        own[lang] = (csr([f for f, _ in mine], models[lang].index), mask)
        docs_of[lang] = np.asarray(list(freq.values()), dtype=float)
    coded = store(encoded(feats, indexes, full), "subject_ids").df
    width = subjects + BACKGROUND + subjects
    schema = "lang int, term int, " + ", ".join(f"c{k} double" for k in range(width))
    for turn in range(ITERATIONS):
        shared = spark.sparkContext.broadcast({lang: m.topics.astype(np.float32) for lang, m in models.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = {lang: Model({}, t, t, t) for lang, t in shared.value.items()}
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for lang, _, table in tables(batch):
                    if lang not in sums:
                        sums[lang] = np.zeros((len(now[lang].topics), width))
                    sums[lang] += np.concatenate(statistics(now[lang], table, subjects), axis=1)
            for lang, total in sums.items():
                at = np.flatnonzero(total.any(axis=1))
                arrays = [pa.array(np.full(len(at), LANGUAGES.index(lang), dtype=np.int32)), pa.array(at.astype(np.int32)), *[pa.array(total[at, k]) for k in range(width)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "term", *[f"c{k}" for k in range(width)]])

        sums = coded.where("sure").select("lang", "cols", "vals").mapInArrow(run, schema).groupBy("lang", "term").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(width)])
        got = sums.toArrow().to_pandas()
        shared.destroy()
        moved = 0.0
        for lang, m in models.items():
            total = np.zeros((len(m.index), width))
            part = got[got["lang"] == LANGUAGES.index(lang)]
            total[part["term"].to_numpy()] = part.iloc[:, 2:].to_numpy()
            table, mask = own[lang]
            if len(table[0]) > 1:
                total += np.concatenate(statistics(m, table, subjects, mask), axis=1)
            models[lang] = updated(m, total[:, : subjects + BACKGROUND], total[:, subjects + BACKGROUND :], docs_of[lang], subjects, turn >= 2)
            if len(m.index):
                moved = max(moved, float(np.abs(models[lang].topics - m.topics).sum(axis=0).mean()) / 2)
        if turn >= 4 and moved < SETTLED:
            break
    return Fitted(known.names, models), coded


def assigned(coded: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, subject, share: the subjects of each document and their shares of its subject tokens."""
    subjects, names = len(fitted.names), np.asarray(fitted.names, dtype=object)
    shared = coded.sparkSession.sparkContext.broadcast({lang: m.topics.astype(np.float32) for lang, m in fitted.models.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for lang, rows, table in tables(batch):
                _, counts = expected(shared.value[lang], table, subjects)
                doc, subject = np.nonzero(assign(counts, subjects))
                own = counts[:, :subjects]
                share = own[doc, subject] / own.sum(axis=1)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(docs[rows[doc]]), pa.array(list(names[subject]), pa.string()), pa.array(share.astype(float))], names=["doc_id", "subject", "share"])

    return coded.mapInArrow(run, "doc_id bigint, subject string, share double")


def subject_areas(docs: DataFrame, examples: DataFrame, areas: DataFrame) -> DataFrame:
    """doc_id, subject, share."""
    known = labelled(examples, areas)
    fitted, coded = fit(store(features(docs, known.markers), "subject_terms").df, known)
    return assigned(coded, fitted)


def found(docs: DataFrame, examples: DataFrame, areas: DataFrame) -> DataFrame:
    """doc_id, subject."""
    return subject_areas(docs, examples, areas).select("doc_id", "subject").distinct()
