"""Predicates and search arithmetic by case."""

import pytest
from pyspark.sql import functions as F

from skein.functions import predicates as P
from skein.operators import search as S
from skein.plans import api


def value(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path,test", [("tests/a.py", True), ("src/test_a.py", True), ("src/a_test.go", True), ("a.spec.ts", True), ("src/bench.rs", True), ("x/fixtures/a", True), ("src/latest.py", False), ("src/attest/a.py", False), (None, False)])
def test_paths_of_tests(spark, path, test):
    assert value(spark, P.is_test_path(F.lit(path).cast("string"))) is test


def test_kinds_and_functions(spark):
    assert [value(spark, P.kind_rank(F.lit(k))) for k in ("function", "const", "import", "other")] == [0, 1, 2, 1]
    fn = lambda *a: value(spark, P.is_test_function(*[F.lit(x) for x in a]))
    assert fn("function", True, None, "a") and fn("function", None, "x, tokio::test", "a") and not fn("function", None, "attest", "a") and not fn("struct", True, None, "tests/a")
    assert value(spark, P.is_trait_method(F.lit("function"), F.lit("Clone"))) and not value(spark, P.is_trait_method(F.lit("struct"), F.lit("clone")))


@pytest.mark.parametrize("pattern,path,hit", [("a/b", "a/b", True), ("a/*", "a/x/y", True), ("a/*.rs", "a/x.rs", True), ("a/*.rs", "a/x.py", False), ("a/*b*c", "a/zzz", True), ("*.md", "x.md", True)])
def test_glob(spark, pattern, path, hit):
    assert value(spark, P.simple_glob(F.lit(path), F.lit(pattern))) is hit


@pytest.mark.parametrize("a,b", [("/users/:id", "/users/<param>"), ("/a/{x}/b/[y]", "/a/<param>/b/<param>"), ("/plain", "/plain")])
def test_routes(spark, a, b):
    assert value(spark, P.normalized_route(F.lit(a))) == b


def test_names(spark):
    assert value(spark, P.pascal_case(F.lit("getUser"))) == "GetUser" and value(spark, P.operation_key(F.lit("List_users"))) == "listusers"
    assert [value(spark, P.sdk_method(F.lit(n))) for n in ("getUsers", "deleteX", "postal", "put", "other")] == ["GET", "DELETE", "GET", "PUT", "GET"]
    assert [value(spark, P.language_family(F.lit(x))) for x in ("TypeScript", "jsx", "Python")] == ["ecmascript", "ecmascript", "python"]
    assert P.path_and_name("a/b/c") == ("a/b", "c") and P.path_and_name("abc") is None and P.path_and_name("/c") is None
    assert value(spark, P.is_generated_sdk(F.lit("x/Sdk.gen.ts"))) and not value(spark, P.is_generated_sdk(F.lit("sdk.gen/x.ts")))


def test_call_sites(spark):
    body = "load_all(x); self.push_all (y); a::make_it(z); if(q) { abc(); $emit4(1) }"
    assert set(value(spark, P.call_sites(F.lit(body)))) == {"load_all", "$emit4"}
    assert set(value(spark, P.method_call_sites(F.lit(body)))) == {"push_all"}
    assert value(spark, P.quoted_after(F.lit("q.publish( 'a', \"b\")"), ".publish(")) == "a" and value(spark, P.quoted_after(F.lit("x.publish(v)"), ".publish(")) is None
    assert value(spark, P.all_quoted_after(F.lit("emit('a'); emit(\"b\")"), "emit(")) == ["a", "b"]


def test_messages(spark):
    assert value(spark, P.branch_name(F.lit("Merge branch 'x/y' into main\n\nbody"))) == "x/y"
    assert value(spark, P.branch_name(F.lit("Merge pull request #3 from me/fix "))) == "me/fix" and value(spark, P.branch_name(F.lit("Fix"))) is None
    assert value(spark, P.outcome_tags(F.lit("[outcome: a ] [outcome:b] [outcome:a] [outcome:]"))) == ["a", "b"]


def test_filters(spark):
    assert value(spark, P.in_subsystem(F.lit("Core/IO"), "core")) and not value(spark, P.in_subsystem(F.lit("coreio"), "core"))
    assert value(spark, P.like_literal(F.lit("50%_x"), "%_")) and not value(spark, P.like_literal(F.lit("50ab"), "%_"))
    assert value(spark, P.in_root(F.lit("external"), "r")) and not value(spark, P.in_root(F.lit("q"), "r")) and value(spark, P.in_root(F.lit("q"), "All"))
    assert not value(spark, P.at_least_complex(F.lit("function"), F.lit(None).cast("int"), 1))
    assert value(spark, P.result_in_root(F.lit("q:a"), F.lit("markdown"), "r")) and not value(spark, P.result_in_root(F.lit("q:a"), F.lit("code:function"), "r"))


def test_nearest_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 5))
    m[7] = m[3]
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)] + [(90, None), (91, [0.0] * 5), (92, [1.0])], "id int, embedding array<double>")
    q = v.where("id % 20 = 0 or id = 90").withColumnRenamed("id", "query")
    got = {}
    for r in S.nearest(v, q, 4, block=2).collect():
        got.setdefault(r["query"], []).append((r["place"], r["id"]))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for k in (0, 20, 40):
        want = sorted(range(60), key=lambda i: (-max(round(float(u[k] @ u[i]), 12), 0), i))[:4]
        assert [i for _, i in sorted(got[k])] == want
    assert set(got) == {0, 20, 40} and S.nearest(v.where("false"), q, 3).collect() == [] and S.nearest(v, q.where("false"), 3).collect() == []


def test_keyword_fusion_and_supplement(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "Red dog"), (3, None), (4, "blue"), (5, "")], "id int, text string")
    hits = S.bm25(S.postings(docs, "id", "text"), S.corpus_lengths(docs, "text"), "red fox")
    rank = [r["id"] for r in hits.orderBy(F.desc("score")).collect()]
    assert rank == [1, 2]
    other = spark.createDataFrame([(2, 0.9), (4, 0.5)], "id int, score double")
    fused = {r["id"]: r["score"] for r in S.fuse(hits, other).collect()}
    assert fused[2] == pytest.approx(1 / 62 + 1 / 61) and fused[4] == pytest.approx(1 / 62)
    more = S.supplement(hits, other, 2)
    assert {(r["id"], r["source_rank"]) for r in more.collect()} == {(1, 0), (4, 1)}
    again = S.rerank(docs.where("text is not null"), "blue", None)
    assert {r["id"]: r["rerank"] for r in again.collect()}[4] == 1.0


def test_fusion_and_hits_keep_whole_lists(spark):
    left = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("score")).repartition(5)
    right = spark.createDataFrame([(2999, 1.0), (5000, 0.5)], "id bigint, score double")
    order = sorted(range(3000), key=lambda i: (-(i % 7), i))
    assert {r["id"]: r["place"] for r in S.places(left).collect()} == {i: k + 1 for k, i in enumerate(order)}
    want = {i: 1 / (61 + k) for k, i in enumerate(order)}
    want[2999] += 1 / 61
    want[5000] = 1 / 62
    assert {r["id"]: r["score"] for r in S.fuse(left, right).collect()} == pytest.approx(want)
    found = S.resolve_hits(left, spark.range(4000)).collect()
    assert {r["id"]: r["place"] for r in found} == {i: k + 1 for k, i in enumerate(order)} and S.places(left.where("false")).collect() == []
    assert {r["id"] for r in S.resolve_hits(left, spark.range(4000), 5).collect()} == set(order[:5])


def test_sections(spark):
    score = lambda h, lv, c, s=None: value(spark, S.section_score("Cache", F.lit(h), F.lit(lv), F.lit(c), s))
    assert score("# Cache", 1, "x") == pytest.approx(1.1) and score("The cache", 2, "cache cache") == pytest.approx(0.7 + 0.08 + 0.04)
    assert score("Other", 5, "x cache", F.array(F.lit("cache.get"))) == pytest.approx(0.4 + 0.04 + 0.15 + 0.02) and score("a", 1, None) is None
    points = lambda h, lv, c, f=False, a=None: value(spark, S.section_points("cache", F.lit(h), F.lit(lv), F.lit(c), F.lit(f), a))
    assert points("Cache", 1, "") == 16 and points("x", 1, "cache") == 8 and points("x", 0, "cache", True) == 5 and points("x", 3, "", False, F.array(F.lit("A cache"))) == 8


def test_vectors_and_upsert(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "id int, text string")
    v = {r["id"]: r["embedding"] for r in S.hashed_vectors(docs, "id", "text", 16).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1.0, abs=1e-5) and sum(v[2]) == 0 and len(v[1]) == 16
    old = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, text_hash string")
    new, stale, kept = S.upsert_embeddings(old, spark.createDataFrame([(1, "x"), (2, "Y"), (4, "w")], "id int, text_hash string"))
    assert [sorted(r["id"] for r in d.collect()) for d in (new, stale, kept)] == [[2, 4], [2, 3], [1]]


@pytest.mark.parametrize("seconds,text", [(3, "just now"), (45, "45s ago"), (200, "3m ago"), (7300, "2h ago"), (200_000, "2d ago")])
def test_age(seconds, text):
    assert api.age(seconds) == text


def test_minify(spark):
    from skein.functions.minify import minified, minify

    text, legend = minify('def f(self, payload):\n    """Doc."""\n    # note\n    quantity = payload.size  # x\n\n    message = "quantity of"\n    return quantity + quantity.size\n', "a.py")
    assert text == 'def f(self, payload):\n    quantity = payload.size\n    message = "quantity of"\n    return quantity + quantity.size' and legend == {}
    text, legend = minify("fn f(x: u8) -> u8 {\n  let counter = x; // c\n  let label = \"x\";\n  counter + counter\n}", "a.rs")
    assert legend == {"a": "counter"} and text == 'fn f(x: u8) -> u8 {\n  let a = x;\n  let label = "x";\n  a + a\n}'
    assert minify(None, "a.py") == (None, {}) and minify("", None) == ("", {})
    df = spark.createDataFrame([("i", "a.py", None, "x = 1  # c\n"), ("j", None, None, None)], "id string, file string, language string, body string")
    assert {(r["id"], r["body"]) for r in minified(df).collect()} == {("i", "x = 1"), ("j", None)}
