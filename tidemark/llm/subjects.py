"""Subject areas of documents.

Learned from documents with labels: which words and pairs of words belong to which subject (a lexicon, sharpened sentence by
sentence, since a document's sentences don't all treat its subject), and a chain of classifiers over what its words and
sentences, the source and the structure say of a document. The chain decides: a beam search over its calibrated chances gives
a document's subjects. Applied to all documents whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import OWN
from tidemark.llm.chains import Chain, fit_logistic
from tidemark.llm.prose import sentences, words

#: Bounds of the sample that models are fitted on: documents with labels; of each of them sentences, evenly spaced, and words
#: of a sentence. All documents are read whole when the model is applied.
LABELLED, SENTENCES, WORDS = 3_500, 200, 60
#: Steps that shares are cut into for the classifiers.
STEPS = 60
OUT = "subjects array<string>, themed int, sentences int"


@dataclass
class Lexicon:
    """Words, and pairs of words that say something else than their words, with their subject and weight."""

    single: dict[str, tuple[int, float]] = field(default_factory=dict)
    pair: dict[str, dict[str, tuple[int, float]]] = field(default_factory=dict)
    #: The number that stands for a theme outside the subjects.
    other: int = -1
    #: Log odds, by words that sentences of all subjects share and by neighbours among these, that a sentence has a theme.
    cues: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0

    def themed(self, sentence: list[str]) -> bool:
        """Whether a sentence speaks of its matter as sentences with known themes do (naive Bayes over the cues)."""
        cues = self.cues
        held = [w for w in sentence if w in cues]
        return len(held) > 1 and self.prior + sum(cues[w] for w in set(held)) + sum(cues.get(f"{a} {b}", 0.0) for a, b in set(zip(held, held[1:]))) > 0

    def read(self, sentence: list[str]) -> tuple[int, list[tuple[int, float]]]:
        """The subject that a sentence treats, ``other`` for a theme outside them, -1 for none; and what its words say, as
        (subject, weight). A pair stands in for both of its words."""
        single, pair = self.single, self.pair
        hits = []
        last = len(sentence) - 1
        skip = -1
        for i, w in enumerate(sentence):
            if i == skip:
                continue
            if i < last and w in pair and (hit := pair[w].get(sentence[i + 1])):
                hits.append(hit)
                skip = i + 1
            elif hit := single.get(w):
                hits.append(hit)
        if not hits:
            return (self.other if self.cues and self.themed(sentence) else -1), hits
        first = hits[0][0]
        if all(h[0] == first for h in hits):
            return first, hits
        total: dict[int, float] = {}
        for k, v in hits:
            total[k] = total.get(k, 0.0) + v
        return max(sorted(total), key=lambda k: total[k]), hits

    def subject(self, sentence: list[str]) -> int:
        return self.read(sentence)[0]


def learn_lexicon(documents: list[list[list[str]]], labels: list[list[int]], subjects: int, least: int | None = None, rounds: int = 4) -> Lexicon:
    """``documents``: the words of each sentence, one document a page; ``labels``: a document's subjects, none if unknown.

    First guess: how the documents that hold a word (or pair) spread over the subjects. Then, in turn: each sentence is
    given the subject that its words speak for, or none, and words are counted by the subjects of their sentences. What
    sentences of all subjects share falls out; a word of one subject that stands in documents of another is put right.

    Sentences may treat themes outside the subjects. Which sentences have any theme is learned from the words that sentences
    of all subjects share, by naive Bayes: those with a known theme against the rest, which holds the others until they are
    found. Their own words then make up one more class, numbered ``subjects``.

    A word needs ``least`` sentences and documents to count: by default one for every 700 documents, five at most.
    """
    least = least or min(5, -(-len(documents) // 700))
    vocabulary: dict[str, int] = {}
    ids, places, owner = [], [], []
    n = 0
    for d, doc in enumerate(documents):
        for s in doc:
            features = {vocabulary.setdefault(w, len(vocabulary)) for w in s} | {vocabulary.setdefault(f"{a} {b}", len(vocabulary)) for a, b in zip(s, s[1:])}
            ids += features
            places += [n] * len(features)
            owner.append(d)
            n += 1
    if not n or not vocabulary:
        return Lexicon()
    feature, sentence, owner = np.array(ids), np.array(places), np.array(owner)
    size = len(vocabulary)
    spread = np.zeros((len(documents), subjects))
    for d, ks in enumerate(labels):
        for k in ks:
            spread[d, k] += 1 / len(ks)
    known = spread.sum(axis=1) > 0
    prior = spread.sum(axis=0) + 1
    prior /= prior.sum()
    once = np.unique(feature.astype(np.int64) * len(documents) + owner[sentence])
    f, d = once // len(documents), once % len(documents)
    pages = np.bincount(f, minlength=size)
    seen = known[d]
    counts = np.stack([np.bincount(f[seen], spread[d[seen], k], minlength=size) for k in range(subjects)], axis=1)

    def weigh(counts: np.ndarray, total: np.ndarray, purest: float) -> np.ndarray:
        p = (counts + 2 * prior) / (total[:, None] + 2)
        w = np.log(p / prior)
        w[(total < least) | (pages < least) | (counts.max(axis=1) < purest * total)] = 0
        return w

    def assign(weights: np.ndarray, classes: int) -> np.ndarray:
        """The class of each sentence: the one that its words speak for most, if one of them speaks clearly."""
        score = np.stack([np.bincount(sentence, weights[feature, k], minlength=n) for k in range(classes)], axis=1)
        best = score.argmax(axis=1)
        strongest = np.zeros(n)
        np.maximum.at(strongest, sentence, weights[feature, best[sentence]])
        best[strongest < 0.7] = -1
        return best

    def tally(best: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each word stands in sentences of each class, and in any sentence."""
        cells = np.bincount(feature * (classes + 1) + np.where(best < 0, classes, best)[sentence], minlength=size * (classes + 1)).reshape(size, classes + 1)
        return cells[:, :classes].astype(float), cells.sum(axis=1).astype(float)

    weights = weigh(counts, counts.sum(axis=1), 0.5)
    total = counts.sum(axis=1)
    for _ in range(rounds):
        best = assign(weights, subjects)
        counts, total = tally(best, subjects)
        weights = weigh(counts, total, 0.6)

    # themes outside the subjects: sentences that speak as those with known themes do, but of other words
    names = list(vocabulary)
    shared = (counts > 0).sum(axis=1) >= max(2, (subjects + 1) // 2)
    often = max(4 * least, 0.0025 * (best >= 0).sum())  # names are shared too, but each is rare
    common = shared & (counts.sum(axis=1) >= often) & ~weights.any(axis=1)
    held = [[w for w in s if common[vocabulary[w]]] for doc in documents for s in doc]
    cells: dict[str, int] = {}
    ids, places = [], []
    for i, h in enumerate(held):
        now = {cells.setdefault(f, len(cells)) for f in [*h, *(f"{a} {b}" for a, b in zip(h, h[1:]))]} if len(h) > 1 else ()
        ids += now
        places += [i] * len(now)
    cue, at = np.array(ids, dtype=np.int64), np.array(places, dtype=np.int64)
    fits, cues, odds = best >= 0, np.zeros(len(cells)), 0.0
    for _ in range(3 if len(cells) else 0):
        yes = np.bincount(cue[fits[at]], minlength=len(cells))
        no = np.bincount(cue, minlength=len(cells)) - yes
        cues = np.log((yes + 0.5) / (fits.sum() + 1)) - np.log((no + 0.5) / ((~fits).sum() + 1))
        odds = float(np.log((fits.sum() + 1) / ((~fits).sum() + 1)))
        fits = (best >= 0) | ((np.bincount(at, cues[cue], minlength=n) + odds > 0) & (np.bincount(at, minlength=n) > 0))
    classes = subjects + 1
    prior = np.append(prior, prior.min()) / (1 + prior.min())
    for _ in range(3):
        best[(best < 0) & fits] = subjects
        counts, total = tally(best, classes)
        weights = weigh(counts, total, 0.6)
        weights[(counts.argmax(axis=1) == subjects) & (counts[:, subjects] < 0.8 * total)] = 0
        best = assign(weights, classes)
    top, peak = counts.argmax(axis=1), counts.max(axis=1) / np.maximum(total, 1)  # a word of several subjects peaks low
    lexicon = Lexicon(other=subjects, cues=dict(zip(cells, cues.tolist())), prior=odds)
    strong = np.flatnonzero(weights.any(axis=1))
    for i in strong.tolist():
        if " " not in names[i]:
            lexicon.single[names[i]] = (int(top[i]), float(weights[i, top[i]]))
    for i in strong.tolist():
        if " " in names[i]:
            a, b = names[i].split(" ")
            parts = [(vocabulary[w], w) for w in (a, b)]
            if peak[i] > 0.95 and any(0.2 < peak[j] < 0.95 and not common[j] for j, w in parts):
                lexicon.pair.setdefault(a, {})[b] = (int(top[i]), float(weights[i, top[i]]))
    return lexicon


@dataclass
class Measured:
    """What the lexicon finds in documents: sentences and weight of words by subject (the last column: other themes), the
    number of sentences, whether there is a table."""

    found: np.ndarray
    terms: np.ndarray
    said: np.ndarray
    tables: np.ndarray


@dataclass
class Model:
    """All that is needed to give a document its subjects; a few hundred kilobytes, bounded by the sample's size."""

    subjects: list[str]
    sources: list[str]
    lexicon: Lexicon
    #: Where the share of a subject is cut into steps, and what the steps and the other evidence say, for all subjects alike.
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    evidence: np.ndarray | None = None
    chain: Chain | None = None

    def measure(self, documents: list[list[list[str]]], tables: list[int]) -> Measured:
        """``documents``: the words of each sentence."""
        found, terms = np.zeros((len(documents), len(self.subjects) + 1)), np.zeros((len(documents), len(self.subjects) + 1))
        read = self.lexicon.read
        for d, said in enumerate(documents):
            for s in said:
                k, hits = read(s)
                if k >= 0:
                    found[d, k] += 1
                for c, v in hits:
                    terms[d, c] += v
        return Measured(found, terms, np.array([len(x) for x in documents], dtype=float), np.array(tables, dtype=float))

    def _shares(self, m: Measured) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        themed = m.found.sum(axis=1, keepdims=True)
        return m.found / np.maximum(themed, 1), m.terms / np.maximum(m.terms.sum(axis=1, keepdims=True), 1e-9), themed[:, 0]

    def _pairs(self, m: Measured) -> np.ndarray:
        """Documents x subjects x evidence: steps of the subject's share, the share of words that speak for it, the greatest
        share of another."""
        part, term, themed = self._shares(m)
        k = len(self.subjects)
        rest = np.stack([np.delete(part, i, axis=1).max(axis=1) for i in range(k)], axis=1)
        steps = part[:, :k, None] >= self.cuts
        return np.concatenate([steps, part[:, :k, None], term[:, :k, None], rest[:, :, None], np.repeat(np.log1p(themed)[:, None, None], k, axis=1)], axis=2).astype(float)

    def features(self, m: Measured, sources: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """What all labels see (terms and sentences by subject, structure, source), and what each sees of its own."""
        part, term, themed = self._shares(m)
        named = np.array([[s == k for k in self.sources] for s in sources], dtype=float).reshape(len(sources), len(self.sources))
        structure = np.stack([np.log1p(themed), np.log1p(m.said), m.tables, themed > 0], axis=1)
        pairs = self._pairs(m)
        own = np.concatenate([(pairs @ self.evidence[:-1] + self.evidence[-1])[:, :, None], pairs[:, :, len(self.cuts) :]], axis=2)
        return np.hstack([part, term, structure, named]), own

    def fit(self, m: Measured, sources: list[str | None], y: np.ndarray) -> "Model":
        """Learns from ``y`` (documents x subjects) how shares of sentences and of words become labels: first one curve for
        all subjects, then the chain over it and the rest."""
        shares = np.sort(self._shares(m)[0][:, : len(self.subjects)].ravel())
        shares = shares[shares > 0]
        if len(shares):
            seen = np.unique(shares)
            picked = np.unique(np.minimum(np.searchsorted(seen, np.linspace(0, 1, STEPS + 1)), len(seen) - 1))
            self.cuts = (seen[picked] + np.where(picked > 0, seen[np.maximum(picked - 1, 0)], 0)) / 2
        pairs = self._pairs(m)
        self.evidence = fit_logistic(pairs.reshape(-1, pairs.shape[2]), y.ravel(), 0.3)
        x, own = self.features(m, sources)
        self.chain = Chain(len(self.subjects)).fit(x, y, own)
        return self

    def assign(self, texts: list[str | None], sources: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Subjects, themed sentences and sentences of each text: the likeliest combination that the beam finds. A document
        without themed sentences has none."""
        if not texts:
            return [], np.zeros(0), np.zeros(0)
        m = self.measure([[words(s) for s in sentences(t)] for t in texts], [int(bool(t) and "{|" in t) for t in texts])
        themed = m.found.sum(axis=1)
        if self.chain is None:
            return [[] for _ in texts], themed, m.said
        kept = self.chain.decode(*self.features(m, sources))[:, 0] & (themed > 0)[:, None]
        return [[self.subjects[k] for k in np.flatnonzero(row)] for row in kept], themed, m.said


def fit(rows: list[dict], areas: list[str]) -> Model:
    """Lexicon and chain from documents given as ``said`` (words by sentence), ``labels`` (None if unknown), ``page_id``,
    ``doc_id``, ``source`` and ``tables``.

    Of a page's revisions one is used, so that names of a page don't pass for themes. Documents in which nothing speaks for
    any subject count as examples without labels. Without any labelled document the model gives no subjects. Labels outside
    ``areas`` are ignored.
    """
    rows = sorted(rows, key=lambda r: (r["labels"] is None, r["doc_id"]))
    place = {s: i for i, s in enumerate(areas)}
    pages, one = set(), []
    for r in rows:
        page = r["page_id"] if r["page_id"] is not None else ("", r["doc_id"])
        if page not in pages:
            pages.add(page)
            one.append(r)
    given = [[place[s] for s in r["labels"] or [] if s in place] for r in one]
    names = {r["source"] for r in one if r["source"] is not None}
    model = Model(areas, sorted(names), learn_lexicon([r["said"] for r in one], given, len(areas)))
    if any(given):
        m = model.measure([r["said"] for r in one], [r["tables"] for r in one])
        silent = m.found[:, : len(areas)].sum(axis=1) == 0
        used = np.flatnonzero(np.array([bool(g) for g in given]) | silent)
        y = np.zeros((len(one), len(areas)))
        for i, g in enumerate(given):
            y[i, g] = 1
        model.fit(Measured(m.found[used], m.terms[used], m.said[used], m.tables[used]), [one[i]["source"] for i in used], y[used])
    return model


def _sample(documents: DataFrame, labels: DataFrame, labelled: int, unlabelled: int) -> DataFrame:
    """The documents that models are fitted on: chosen by a hash of the id, as many whatever the corpus. Their ids, at
    most ``labelled + unlabelled``, are broadcast, so the texts are scanned and not shuffled."""
    given = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("labels"))
    chosen = given.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(labelled).select("doc_id", "labels")
    if unlabelled:
        others = documents.select("doc_id").where(F.col("doc_id").isNotNull()).withColumn("_h", F.xxhash64(F.lit(1), "doc_id")).orderBy("_h", "doc_id").limit(unlabelled)
        both = chosen.unionByName(others.select("doc_id", F.lit(None).cast("array<string>").alias("labels")))
        chosen = both.groupBy("doc_id").agg(F.max("labels").alias("labels"))
    return documents.where(F.length("text") > 0).select("doc_id", "page_id", "source", "text").join(F.broadcast(chosen), "doc_id")


PARSED = "doc_id bigint, page_id bigint, source string, labels array<string>, said string, tables int"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each sentence, a line a sentence, in place of the text; of many sentences ``SENTENCES``, evenly spaced."""
    for b in batches:
        texts = b.column(b.schema.get_field_index("text")).to_pylist()
        said = []
        for t in texts:
            every = sentences(t)
            if len(every) > SENTENCES:
                every = [every[i * len(every) // SENTENCES] for i in range(SENTENCES)]
            said.append("\n".join(" ".join(words(s)[:WORDS]) for s in every))
        kept = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "page_id", "source", "labels")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(said, type=pa.string()), pa.array([int("{|" in t) for t in texts], type=pa.int32())], names=["doc_id", "page_id", "source", "labels", "said", "tables"])


def train(documents: DataFrame, labels: DataFrame, areas: list[str], labelled: int = LABELLED, unlabelled: int = 0) -> Model:
    """Lexicon and chain, fitted on the driver on at most ``labelled`` documents with labels (and ``unlabelled`` others, none
    by default), bounded by ``SENTENCES`` and ``WORDS``; sentences are parsed on the executors. See ``fit``."""
    sample = _sample(documents, labels, labelled, unlabelled)
    ids = sample.select(F.col("doc_id").cast("bigint"), F.col("page_id").cast("bigint"), F.col("source").cast("string"), "labels", "text")
    rows = ids.mapInArrow(_parsed, PARSED).toArrow().to_pylist()
    for r in rows:
        r["said"] = [s.split() for s in r["said"].split("\n")] if r["said"] else []
    return fit(rows, areas)


def _assigner(model: Model, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 500):
                b = whole.slice(at, 500)
                found, themed, said = model.assign(b.column(keep).to_pylist(), b.column(keep + 1).to_pylist())
                made = [pa.array(found, type=pa.list_(pa.string())), pa.array(themed.astype(np.int32)), pa.array(said.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*b.columns[:keep], *made], names=[*b.schema.names[:keep], "subjects", "themed", "sentences"])

    return run


def assign_subjects(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and each document's ``subjects``, themed sentences and sentences; one row per row.

    Null and empty texts, redirects, templates, lists and texts without themed sentences get an empty list. Texts are
    read whole; nothing is shuffled.
    """
    rows = documents.select(*keep, F.col("text").alias(f"{OWN}text"), F.col("source").alias(f"{OWN}source"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(_assigner(model, len(keep)), f"{kinds}, {OUT}")


def makeup(assigned: DataFrame, areas: list[str]) -> DataFrame:
    """The corpus by subject: documents that have it, themed sentences behind them, and documents counted in equal parts
    over their subjects (which add up to the documents with any). A subject no document has comes with zeros."""
    each = assigned.where(F.size("subjects") > 0).select(F.explode("subjects").alias("subject"), "themed", (1 / F.size("subjects")).alias("part"))
    sums = each.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("themed").alias("themed_sentences"), F.sum("part").alias("parts"))
    every = assigned.sparkSession.createDataFrame([(a,) for a in areas], "subject string")
    return every.join(sums, "subject", "left").select("subject", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("themed_sentences", F.lit(0)).alias("themed_sentences"), F.round(F.coalesce("parts", F.lit(0.0)), 4).alias("parts"))
