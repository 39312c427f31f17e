"""Pieces, tokens and containers: exact round trips and brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import packing, pieces, tokens

ODD = st.text(st.sampled_from(list("ab'strevdlm  \n\t .!9²é'’日本́𝒳{};\r")), max_size=400)


def check(text, limit, overlap):
    cuts = pieces.cuts(text, limit, overlap)
    assert (cuts == []) == (text == "")
    if text:
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(0 < b - a <= limit for a, b in cuts)
        assert all(c == b - overlap and d > b for (_, b), (c, d) in zip(cuts, cuts[1:], strict=False))
        assert text == text[: cuts[0][1]] + "".join(text[a + overlap : b] for a, b in cuts[1:])
    return cuts


@given(ODD, st.integers(2, 90), st.data())
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text(text, limit, data):
    check(text, limit, data.draw(st.integers(0, limit - 1)))


def test_pieces_agree_with_sequential_greedy():
    r = random.Random(3)
    for _ in range(40):
        text = "".join(r.choice(["ab", " ", "\n", "\n\n", "def f", ";", "x" * 30]) for _ in range(200))
        ranks = pieces.boundaries(text)
        got, at, want = pieces.cuts(text, 60, 10), 10, []
        while at < len(text):
            import numpy as np

            at = int(pieces.successors(np.asarray([at]), ranks, text, 50)[0])
            want.append(at)
        assert [b for _, b in got] == want or len(text) <= 60


def test_pieces_prefer_natural_boundaries():
    text = "def a():\n    return 1\n\n" * 40
    cuts = check(text, 300, 20)
    assert all(text[b - 2 : b] == "\n\n" for _, b in cuts[:-1])
    assert all(text[b:].startswith("́") is False for _, b in check("é" * 500, 100, 7))
    with pytest.raises(ValueError):
        pieces.cuts("x", 5, 5)


def test_split_operator(spark):
    rows = [("a", "x" * 6001), ("a", "x" * 6001), ("a", "y" * 6001), ("b", "x" * 6000), ("c", None), ("d", ""), (None, "é" * 7000), ("e", "z" * 300_000)]
    df = spark.createDataFrame(rows, "id string, body string").selectExpr("id", "body", "1 as text", "2 as piece")
    out = pieces.split_oversized(df).collect()
    assert {(r["id"], r["text"][0]) for r in out} == {("a", "x"), ("a", "y"), (None, "é"), ("e", "z")}
    assert max(len(r["text"]) for r in out) <= 6000 and len([r for r in out if r["id"] == "a"]) == 4
    assert {r[0] for r in pieces.found(df).collect()} == {"a", None, "e"}
    assert pieces.found(df.where("false")).collect() == []


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.rank_bytes())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@given(ODD)
@settings(max_examples=400, deadline=None)
def test_tokens_equal_the_library(encoder, reference, text):
    assert encoder.encode(text) == reference.encode(text, add_special_tokens=False).ids
    assert encoder.decode(encoder.encode(text)) == text


@pytest.mark.parametrize("text", ["", " ", "  ", "\n\n", " \n x", "don't'll've's", "''s 's", "<|endoftext|>", "\u00a0\u3000x", "a" * 5000, "ab" * 50_000, "\ufeffx", "x\x85y\x1cz", "1²३Ⅷ", "🏳️‍🌈"])
def test_tokens_by_case(encoder, reference, text):
    assert encoder.encode(text) == reference.encode(text, add_special_tokens=False).ids
    ids, at, counts = encoder.encode_with_slices(text)
    assert sum(counts) == len(ids) and list(at) == sorted(set(at)) and at[-1] == len(text)


def test_encode_operator(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (3, ""), (None, "x")], "doc_id long, text string").selectExpr("*", "0 as ids", "0 as _text")
    rows = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in tokens.encode(df).collect()))
    assert [i for i, _ in rows] == [0, 1, 2, 3, 3] and rows[2][1] == rows[3][1] == []
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df)).collect()}
    assert back[1] == "hello world" and back[2] == ""
    full = tokens.encode(df, offsets=True).where("doc_id = 1").first()
    assert list(full["slice_start"]) == [0, 5] and sum(full["slice_ids"]) == len(full["ids"])
    assert tokens.encode(df.where("false")).collect() == []


def packed(spark, sizes, limits=None):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens int")
    return packing.pack(df, "doc_id", limits).toPandas()


def valid(out, sizes, limits):
    for _, g in out.groupby("container"):
        g = g.sort_values("start")
        assert g["length"].sum() <= limits.tokens and len(g) <= limits.documents and (g["length"].astype(int) ** 2).sum() <= limits.cost
        ends = (g["start"] + g["length"]).tolist()
        assert all(a <= b for a, b in zip(ends, g["start"].tolist()[1:], strict=False))
    per = out.groupby("doc_id")["length"].sum()
    assert [per[i] for i in range(len(sizes))] == [s or 0 for s in sizes]
    assert all(out.groupby("doc_id")["length"].count()[i] == max(1, -(-(s or 0) // limits.tokens)) for i, s in enumerate(sizes))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_is_valid_and_tight(spark, rule):
    r = random.Random(5)
    sizes = [r.choice([0, 1, 7, 40, 333, 700, 1024, 2047, 2048, 2049, 5000, r.randrange(2048)]) for _ in range(700)] + [None]
    limits = packing.Limits(rule=rule)
    out = packed(spark, sizes, limits)
    valid(out, sizes, limits)
    least = -(-sum(s or 0 for s in sizes) // 2048)
    assert out["container"].nunique() <= least * 1.05 + 1


def test_packing_under_every_constraint(spark):
    sizes = [5] * 50 + [60] * 20 + [0] * 30
    limits = packing.Limits(tokens=100, documents=4, cost=4000)
    valid(packed(spark, sizes, limits), sizes, limits)
    with pytest.raises(ValueError):
        packing.plan({90: 1}, packing.Limits(tokens=100, cost=100))


def test_packing_near_the_optimum_of_small_cases(spark):
    """Against the fewest containers that any order of first fit finds."""
    import itertools

    r = random.Random(1)
    for _ in range(15):
        sizes = [r.randrange(1, 11) for _ in range(6)]
        best = 9
        for order in itertools.permutations(sizes):
            bins = []
            for s in order:
                k = next((i for i, b in enumerate(bins) if b + s <= 10), None)
                if k is None:
                    bins.append(s)
                else:
                    bins[k] += s
            best = min(best, len(bins))
        counts = {s: sizes.count(s) for s in sizes}
        assert sum(packing.plan(counts, packing.Limits(tokens=10)).count) <= best + 1


def test_packing_of_hot_lengths_and_nothing(spark):
    sizes = [512] * 3000 + [100] * 10
    out = packed(spark, sizes)
    valid(out, sizes, packing.Limits())
    assert out["container"].nunique() == 751
    assert len(packed(spark, [])) == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_takes_the_best_of_all_containers(rule):
    """The search that stops early finds the same scores as one over every open container."""
    r = random.Random(9)
    limits = packing.Limits(tokens=200, documents=6, cost=15_000, rule=rule, weights=(1.0, 0.5, 0.5))
    need = lambda s: (s, 1, s * s)
    caps = (limits.tokens, limits.documents, limits.cost)

    def score(rest, s):
        if rule == "dot":
            return -sum(w * (a / c) * (b / c) for w, a, b, c in zip(limits.weights, need(s), rest, caps, strict=True))
        return sum(w * ((b - a) / c) ** 2 for w, a, b, c in zip(limits.weights, need(s), rest, caps, strict=True))

    for _ in range(200):
        open_ = packing._Open(limits)
        states = [(r.randrange(201), r.randrange(1, 7), r.randrange(15_001)) for _ in range(r.randrange(12))]
        for k, state in enumerate(states):
            open_.add(k, state)
        s = r.randrange(0, 123)
        fits = [x for x in states if all(b >= a for a, b in zip(need(s), x, strict=True))]
        got = open_.best(s)
        assert (got is None) == (not fits) and (got is None or score(got, s) == pytest.approx(min(score(x, s) for x in fits)))


def test_plan_of_long_containers_is_quick():
    """300,000 items of 130,000 lengths in containers of 131,072 tokens."""
    import time

    r = random.Random(2)
    counts = {}
    for _ in range(300_000):
        size = min(int(r.lognormvariate(8.8, 1.2)) + 1, 131_072)
        counts[size] = counts.get(size, 0) + 1
    began = time.time()
    bins = packing.plan(counts, packing.Limits(tokens=131_072))
    assert time.time() - began < 20 and sum(bins.count) <= 1.001 * -(-sum(k * n for k, n in counts.items()) // 131_072) + 1


@given(st.text(st.characters(exclude_categories=["Cn", "Cs"]), max_size=60))
@settings(max_examples=400, deadline=None)
def test_slices_of_any_code_points_agree_with_the_pattern(text):
    """Random strings over all assigned code points (others may be assigned in the engine's newer tables), against the published pattern."""
    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+".replace("\\\\", "\\"))
    at = tokens.starts(text).tolist()
    assert [text[a:b] for a, b in zip(at, at[1:], strict=False)] == pattern.findall(text)
