import random

import numpy as np
import pytest

from tidemark.llm import subjects
from tidemark.llm.chains import Chain, fit_logistic
from tidemark.llm.prose import mended, prose, sentences, words


def test_prose_leaves_markup_aside():
    text = "{{Infobox\n| name = court\n| x = {{nested|violin}}\n}}\n'''Title''' (1900). A [[Violin|violin]] of the [[court]].<ref name=\"a\">p. 3</ref> Next &amp;nbsp;one.{{cite|judge}} <!-- jury -->\n\n== Jury ==\n{| class=\"x\"\n|-\n| verdict || 5\n|}\n* [[Judge]]\n[[Category:Law]]\n[http://x.example/1 Label] ends. Open {{template"
    got = sentences(text)
    assert got[0].strip() == "Title (1900)." and "A violin of the court." in [s.strip() for s in got]
    whole = " ".join(got)
    assert not any(w in whole for w in ("Infobox", "nested", "verdict", "jury", "judge", "Judge", "Category", "p. 3", "Jury", "http"))
    assert "Label ends." in whole
    assert sentences(None) == sentences("") == sentences("   \n\n ") == []


def test_wrong_encodings_and_broken_lines_are_mended():
    assert mended("Moquayk BrenikÃ¼ â€“ Ã©") == "Moquayk Brenikü – é" and mended("Ãrea normal") == "Ãrea normal" and mended("plain") == "plain"
    assert words("Zell-\nmembran") == ["zell", "membran"] and "Zellmembran" in prose("Eine Zell-\nmembran.")
    assert words("The X-ray 12 café’s Été") == ["the", "x-ray", "café’s", "été"]


@pytest.mark.parametrize("text", ["{|" * 20_000, "{{" * 3_000, "<ref>" * 20_000, "[[" * 20_000, "<!--" * 20_000, "a" * 500_000, "word. " * 50_000, "'" * 100_000, "-\n" * 50_000])
def test_very_long_and_damaged_texts_end(text):
    assert isinstance(sentences(text), list)


def test_logistic_and_chain_learn_what_goes_together():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    first = (x[:, 0] > 0).astype(float)
    second = ((x[:, 1] > 0) & (first > 0)).astype(float)
    assert fit_logistic(x, first)[0] > 2
    chain = Chain(2).fit(x, np.stack([first, second], axis=1))
    got = chain.decode(x)
    assert got.shape == (2000, 4, 2) and chain.order == [0, 1]
    assert (got[:, 0, 0] == first).mean() > 0.95 and (got[:, 0, 1] == second).mean() > 0.9
    assert len({tuple(r) for r in got[0].tolist()}) == 4  # the beam holds different combinations
    assert Chain(2).fit(x[:10], np.zeros((10, 2))).decode(x[:0]).shape[0] == 0


THEMES = {"law": ["judge", "jury", "verdict", "case file", "statute"], "music": ["violin", "sonata", "choir", "minor key", "tempo"], "software": ["compiler", "file", "kernel", "encryption key", "parser"]}
FRAMES = ["The {a} came before the {b}.", "Most accounts of the {a} begin with the {b}.", "About 9 percent of every {a} involves some {b}."]
FILLER = ["Opinions differ, and the sources don't agree.", "This was repeated in 1811.", "See below for the other uses of the word."]


def corpus(n, seed, wrong=0.05):
    rng, docs, labels, truth = random.Random(seed), [], [], {}
    for i in range(n):
        mine = rng.sample(sorted(THEMES), rng.choice([1, 1, 1, 2]))
        said, counts = [], dict.fromkeys(THEMES, 0)
        for j in range(rng.randint(3, 14)):
            theme = mine[j % len(mine)] if rng.random() < 0.9 else rng.choice(sorted(THEMES))
            a, b = rng.sample(THEMES[theme], 2)
            said.append(rng.choice(FRAMES).format(a=a, b=b))
            counts[theme] += 1
            if rng.random() < 0.5:
                said.append(rng.choice(FILLER))
        text = "{{Infobox\n| name = judge violin\n}}\n" + " ".join(said) + "\n\n{| class=x\n| judge || 1\n|}\n"
        docs.append((i, i // 2 if i % 2 else i, text, rng.choice(["one", "two", None])))
        total = sum(counts.values())
        truth[i] = sorted(t for t, c in counts.items() if c and 4 * c >= total)
        labels += [(i, t) for t in ([rng.choice(sorted(THEMES))] if rng.random() < wrong else truth[i])]
    return docs, labels, truth


DOCS = "doc_id bigint, page_id bigint, text string, source string"


def test_held_out_accuracy_and_documents_without_themes(spark):
    docs, labels, truth = corpus(900, 1)
    extra = [(9001, 1, None, "one"), (9002, 2, "", None), (9003, 3, "#redirect [[Judge]]", "one"), (9004, 4, "{{T\n| a = jury\n}}", None), (9005, 5, "* [[Judge]]\n* [[Jury]]\n{{disambig}}", "two"), (9006, 6, FILLER[0], "new"), (9007, None, "The judge came before the jury. " * 3_000, "one")]
    frame = spark.createDataFrame(docs + extra, DOCS)
    given = spark.createDataFrame([x for x in labels if x[0] < 600] + [(None, "law"), (5, None), (7, "unheard of")], "doc_id bigint, subject string")
    model = subjects.train(frame, given, sorted(THEMES), labelled=500, unlabelled=100)
    out = subjects.assign_subjects(frame, model, ["doc_id"])
    got = {r["doc_id"]: r["subjects"] for r in out.collect()}
    assert len(got) == len(docs) + len(extra)
    assert [got[i] for i in range(9001, 9007)] == [[]] * 6 and got[9007] == ["law"]
    held = [i for i in range(600, 900)]
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.97
    made = {r["subject"]: r for r in subjects.makeup(out, [*sorted(THEMES), "none"]).collect()}
    assert made["none"]["documents"] == 0 and made["law"]["documents"] == sum("law" in s for s in got.values())
    assert abs(sum(r["parts"] for r in made.values()) - sum(bool(s) for s in got.values())) < 0.01


def test_words_of_several_subjects_are_told_apart_by_their_neighbours():
    docs, labels, _ = corpus(400, 2)
    said = [[words(s) for s in sentences(t)] for _, _, t, _ in docs]
    areas = sorted(THEMES)
    given = [[areas.index(s) for d, s in labels if d == i] for i in range(len(docs))]
    lexicon = subjects.learn_lexicon(said, given, len(areas))
    assert areas[lexicon.subject(words("Most accounts of the case file begin."))] == "law"
    assert areas[lexicon.subject(words("Most accounts of the minor key begin."))] == "music"
    assert areas[lexicon.subject(words("Some encryption key came."))] == "software"
    assert lexicon.subject(words(FILLER[0])) == -1 and lexicon.subject([]) == -1


def test_without_labels_or_documents(spark):
    frame = spark.createDataFrame([(1, 1, "The judge came.", "one")], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, subject string")
    model = subjects.train(frame, none, ["law"])
    assert [r["subjects"] for r in subjects.assign_subjects(frame, model, ["doc_id"]).collect()] == [[]]
    model = subjects.train(frame.limit(0), none, ["law"])
    assert subjects.assign_subjects(frame.limit(0), model, ["doc_id"]).count() == 0


def fitted(docs, labels, more=()):
    said = [(i, p, [words(s) for s in sentences(t)], source) for i, p, t, source in [*docs, *more]]
    given = {}
    for d, s in labels:
        given.setdefault(d, []).append(s)
    return subjects.fit([{"doc_id": i, "page_id": p, "said": x, "labels": given.get(i), "source": s, "tables": 0} for i, p, x, s in said], sorted(THEMES))


def test_themes_outside_the_subjects_count_among_the_sentences():
    """A document half of which is about pastry: its law is held against all sentences with any theme."""
    docs, labels, _ = corpus(1500, 3, wrong=0)
    rng = random.Random(4)
    outside = ["pastry crust", "hem stitch", "saucepan", "wool yarn", "marinade"]
    more = [(10_000 + i, 10_000 + i, " ".join([rng.choice(FRAMES).format(a=a, b=b) for a, b in (rng.sample(outside, 2) for _ in range(8))] + FILLER), "one") for i in range(60)]
    model = fitted(docs, labels, more)
    found = lambda text: model.measure([[words(s) for s in sentences(text)]], [0]).found[0].tolist()
    law, pastry = "The judge came before the jury. ", "The wool yarn came before the pastry crust. "
    assert found(law + pastry * 4 + FILLER[0]) == [1, 0, 0, 4]
    assert found("The quince came before the damson. " + FILLER[1]) == [0, 0, 0, 1]  # never seen, said as themes are
    assert model.assign([law + pastry * 6, law * 3 + pastry * 3, pastry], [None] * 3)[0] == [[], ["law"], []]


def test_the_chain_decides():
    """Where labels name a subject only from half of the sentences on, the chain learns that; no share is built in."""
    docs, _, _ = corpus(1200, 5, wrong=0)
    areas = sorted(THEMES)
    base = fitted(docs, [(d[0], "law") for d in docs[:1]] + corpus(1200, 5, wrong=0)[1])
    m = base.measure([[words(s) for s in sentences(t)] for _, _, t, _ in docs], [0] * len(docs))
    part = m.found[:, :3] / np.maximum(m.found.sum(axis=1, keepdims=True), 1)
    strict = [(d[0], areas[k]) for d, row in zip(docs, part) for k in range(3) if row[k] >= 0.5]
    model = fitted(docs, strict)
    two = "The judge came before the jury. " * 4 + "The violin came before the choir. " * 7
    assert base.assign([two], ["one"])[0] == [["law", "music"]] and model.assign([two], ["one"])[0] == [["music"]]
    held = corpus(300, 6)[0]
    differ = sum(a != b for a, b in zip(base.assign([t for _, _, t, _ in held], [None] * 300)[0], model.assign([t for _, _, t, _ in held], [None] * 300)[0]))
    assert differ > 20


def test_terms_and_source_reach_the_chain():
    docs, labels, _ = corpus(600, 7, wrong=0)
    model = fitted(docs, labels)
    m = model.measure([[["the", "judge", "came"]]], [1])
    x, own = model.features(m, ["one"])
    assert x.shape == (1, 4 + 4 + 4 + 2) and own.shape[:2] == (1, 3) and m.terms[0].argmax() == 0
    assert (model.features(m, ["two"])[0] != x).any() and (np.abs(np.array(model.chain.weights[0][: x.shape[1]])) > 1e-6).sum() > 6
