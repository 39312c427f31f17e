"""Subject areas: held-out accuracy on labelled examples, and cases."""

import pytest

from skein.llm import subjects
from skein.session import store

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    return [spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "subject_examples", "subject_areas")]


def test_held_out_examples(spark, data):
    """A fifth of the examples is classified by models that never saw their labels. A few labels are wrong."""
    docs, examples, areas = data
    held = examples.where("example_id % 5 = 0").selectExpr("example_id as doc_id", "text")
    known = subjects.labelled(examples.where("example_id % 5 <> 0"), areas)
    feats = store(subjects.features(docs.select("doc_id", "text").unionByName(held.selectExpr("-doc_id - 1 as doc_id", "text")), known.markers), "feats").df
    fitted, coded = subjects.fit(feats, known)
    got = {}
    for r in subjects.assigned(coded, fitted).where("doc_id < 0").collect():
        got.setdefault(-r["doc_id"] - 1, set()).add(r["subject"])
    want = {r["example_id"]: set(r["subjects"]) for r in examples.where("example_id % 5 = 0").collect()}
    hits = sum(len(got.get(i, set()) & s) for i, s in want.items())
    assert hits / sum(map(len, want.values())) > 0.88
    assert hits / sum(map(len, got.values())) > 0.88
    top = fitted.top_terms("en")
    assert set(top) == {r["subject"] for r in areas.collect()}
    # a subject's top terms stand in its examples more often than in those of the others
    said = {r["example_id"]: (" ".join(subjects.terms(r["text"])), set(r["subjects"])) for r in examples.where("text is not null and subjects is not null").collect()}
    for name, words in top.items():
        inside = sum(w in text for w in words for text, s in said.values() if name in s)
        assert inside > sum(w in text for w in words for text, s in said.values() if name not in s)


def test_wordings_of_passing_mentions_are_learned():
    """Any wording that stands where texts speak of what they are not about; none that stands where they speak of their subject."""
    about = {0: ["field goal", "penalty kick"], 1: ["court ruling", "plea bargain"], 2: ["bond yield", "cash flow"], 3: ["spinal tap", "blood clot"]}
    texts = [(f"The new rule for a {t} holds. We keep every {t} in the list.", [s]) for s, own in about.items() for t in own for _ in range(4)]
    texts += [(f"We keep every {own[0]} in the list. Our sprint was dubbed {about[(s + 1 + k) % 4][k]} by the team.", [s]) for s, own in about.items() for k in (0, 1)]
    learned = subjects.passing_markers(texts, 4)
    assert " sprint was dubbed " in learned and not any("rule" in m or "keep" in m for m in learned)
    found = subjects.terms("Our  sprint\nwas dubbed bond yield by the team. We keep every field goal.", learned)
    assert "field goal" in found and "bond yield" not in found
    assert subjects.passing_markers([], 4) == frozenset() and subjects.passing_markers(texts[:2], 4) == frozenset()


def test_terms_of_any_script_and_beyond_the_table(spark, data, monkeypatch):
    """Every script has terms; with a table too small for the vocabulary rare terms share rows, and most subjects stay."""
    assert {"судно", "порт"} <= set(subjects.terms("Судно вошло в порт. судно 7")) and "港口" in subjects.terms("港口。")
    docs, examples, areas = data
    want = {(r["doc_id"], r["subject"]) for r in subjects.found(docs, examples, areas).collect()}
    monkeypatch.setattr(subjects, "TABLE", 700)
    got = {(r["doc_id"], r["subject"]) for r in subjects.found(docs, examples, areas).collect()}
    assert len(want & got) > 0.9 * len(want | got)


def test_cases(spark, data):
    docs, examples, areas = data
    english = "Importing 9 rows of merge conflict took longer than drawing the garbage collector. The linter rule was computed from yesterday's stack trace."
    passing = "Rounding of the grain silo differed between the crop rotation screen and the hay bale export. (Think of it like a stack trace, if that helps.)"
    rows = [(10**9 + k, t) for k, t in enumerate([None, "", "  ", "ok", english, english, passing, english + " " + passing, "\n".join([english] * 2000), "123 456 ???", "```\n" + english + "\n```"])]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    got = {}
    for r in subjects.found(both, examples, areas).where("doc_id >= 1000000000").collect():
        got.setdefault(r["doc_id"] - 10**9, set()).add(r["subject"])
    assert got == {4: {"software"}, 5: {"software"}, 6: {"agriculture"}, 7: {"software", "agriculture"}, 8: {"software"}}


def test_empty_tables(spark, data):
    docs, examples, areas = data
    assert subjects.found(docs.where("false"), examples, areas).collect() == []
    assert subjects.found(docs.limit(0), examples.where("false"), areas).collect() == []


@pytest.mark.parametrize("a,b", [("vehicles", "vehicle"), ("signses", "sign"), ("Boundarys", "boundary")])
def test_singular(a, b):
    assert subjects.singular(a) == subjects.singular(b)
