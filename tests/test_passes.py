"""Link passes on minimal inputs."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import passes as L

NODE = "id string, root string, file string, name string, kind string, language string, line_start int, line_end int, signature string, body string, decorators string, is_test boolean, metadata map<string,string>"


def node(name, kind="function", file="src/a.py", root="r", **more):
    row = {"id": f"{root}:{file}:{name}:{kind}", "root": root, "file": file, "name": name, "kind": kind, "language": "python", "line_start": 1, "line_end": 9, "signature": "", "body": "", "decorators": None, "is_test": None, "metadata": {}} | more
    return tuple(row[c.split()[0]] for c in NODE.split(", "))


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODE)


def pairs(df):
    short = lambda i: i.rsplit(":", 2)[-2]
    return {(short(r["source_id"]), short(r["target_id"]), r["edge_type"]) for r in df.collect()}


def test_frameworks(spark):
    n = nodes(spark, node("from fastapi import FastAPI", "import"), node('import React from "react"', "import", "a.ts", language="TypeScript"), node("import react", "import", "b.py"), node("import axios", "import", "c.rb", language=None), node("a", "module"))
    assert {(r["file"], r["framework"]) for r in L.frameworks(n).collect()} == {("src/a.py", "fastapi"), ("a.ts", "react"), ("c.rb", "axios")}
    assert pairs(L.framework_edges(n)) == {("a", "fastapi", "depends_on")}


def test_subsystem_frameworks(spark):
    m = spark.createDataFrame([("s", "r", f"f{i}") for i in range(10)], "subsystem string, root string, file string")
    used = spark.createDataFrame([("r", f"f{i}", "x") for i in range(7)] + [("r", f"f{i}", "y") for i in range(6)], "root string, file string, framework string")
    assert [(r["framework"], r["share"]) for r in L.subsystem_frameworks(m, used).collect()] == [("x", 0.7)]


def test_router_prefixes_are_idempotent(spark):
    files = spark.createDataFrame([("r", "a.py", "router = APIRouter(prefix='/v1')\n"), ("r", "main.py", "app.include_router(other.items, prefix=\"/items/\")\n"), ("r", "z.py", None)], "root string, file string, body string")
    ep = lambda file, var: node("GET /x", "api_endpoint", file, metadata={"http_path": "/x", "router_var": var})
    n = nodes(spark, ep("a.py", "router"), ep("b.py", "items"), ep("c.py", "nobody"))
    once = L.apply_router_prefixes(n, L.router_prefixes(files))
    paths = lambda d: {r["file"]: r["metadata"]["http_path"] for r in d.collect()}
    assert paths(once) == {"a.py": "/v1/x", "b.py": "/items/x", "c.py": "/x"}
    assert paths(L.apply_router_prefixes(once, L.router_prefixes(files))) == paths(once)


def test_sdk_paths(spark):
    lit = lambda name, root="r": node(name, "const", "sdk.gen.ts", root)
    ep = lambda path, root="r", **m: node(f"GET {path}", "api_endpoint", "a.py", root, metadata={"http_path": path} | m)
    n = nodes(spark, lit("/api/items"), lit("/api/v1/users"), lit("/api/v2/users"), ep("/items"), ep("/users"), ep("/items", "q"), ep("/tems"), ep("/v1/users", http_path_local="/users"))
    assert {(r["id"], r["http_path"]) for r in L.sdk_full_paths(n).collect()} == {("r:a.py:GET /items:api_endpoint", "/api/items")}


def test_suffix_resolution(spark):
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "path string")
    got = L.resolve_by_suffix(one("a/b.py", "b.py", "c.py", "ba.py", "none"), one("a/b.py", "x/c.py", "y/c.py", "b.py", "q/aba.py").withColumnRenamed("path", "file"))
    assert {(r["path"], r["file"]) for r in got.collect()} == {("a/b.py", "a/b.py"), ("b.py", "b.py")}


def test_url_and_sdk_links(spark):
    n = nodes(
        spark,
        node("/users/:id", "const", metadata={"synthetic": "true"}), node("/users/:x", "const"), node("GET /users/{id}", "api_endpoint", metadata={"http_path": "/users/{id}", "http_method": "get", "operation_id": "get_user"}),
        node("getUser", file="sdk.gen.ts"), node("listItems", file="sdk.gen.ts", line_start=20, line_end=30), node("postItems", file="sdk.gen.ts", line_start=40, line_end=50), node("/items", "const", "sdk.gen.ts", line_start=25), node("/items", "const", "sdk.gen.ts", "r", id="x", line_start=45),
        node("POST /items", "api_endpoint", metadata={"http_path": "/items", "http_method": "POST"}), node("a", "api_endpoint", metadata={"operation_id": "dup", "http_path": "/d", "http_method": "GET"}), node("b", "api_endpoint", metadata={"operation_id": "dup"}), node("dup", file="sdk.gen.ts", line_start=60, line_end=70), node("/d", "const", "sdk.gen.ts", line_start=65),
    )
    assert {(r["source_id"], r["target_id"]) for r in L.url_links(n).collect()} == {("r:src/a.py:/users/:id:const", "r:src/a.py:GET /users/{id}:api_endpoint")}
    assert pairs(L.sdk_links(n)) == {("getUser", "GET /users/{id}", "implements"), ("postItems", "POST /items", "implements")}


def brute_links(tests, names):
    out = set()
    for t in tests:
        low, at = t.lower(), 0
        while at < len(low):
            hit = max((n for n in names if len(n) >= 4 and low.startswith(n.lower(), at)), key=len, default=None)
            if hit:
                out.add((t, hit.lower()))
                at += len(hit)
            else:
                at += 1
    return out


def test_test_links_against_brute_force(spark):
    r = random.Random(2)
    words = ["parse", "config", "get", "load", "parse_config", "ad", "Build"]
    names = sorted({"_".join(r.sample(words, r.randrange(1, 3))) for _ in range(14)})
    tests = sorted({"test_" + "_".join(r.choices(words, k=r.randrange(1, 5))) for _ in range(20)})
    n = nodes(spark, *[node(x) for x in names], *[node(x, file="tests/t.py") for x in tests])
    got = {(a, b.lower()) for a, b, _ in pairs(L.test_links(n))}
    assert got == brute_links(tests, names)
    assert pairs(L.test_links(nodes(spark, node("get"), node("test_get", file="tests/t.py")))) == set()
    many = nodes(spark, node("seal_tray", root="q"), node("seal_tray", root="a"), node("test_seal_tray", file="tests/t.py", root="q"), node("test_seal_tray", file="tests/t.py", root="z"))
    assert {(x["source_id"][0], x["target_id"][0]) for x in L.test_links(many).collect()} == {("q", "q"), ("z", "a")}


@pytest.mark.parametrize(
    "text,names",
    [("import { Foo, Bar as B } from 'x'", ["Foo", "Bar"]), ("import Foo from 'x'", ["Foo"]), ("import Foo, { Bar } from 'x'", ["Foo", "Bar"]), ("import * as ns from 'x'", []), ("import type { A } from 'x'", []), ("import { type A, B } from 'x'", ["B"]), ("from mod import (Foo,\n Bar as b)", ["Foo", "Bar"]), ("import os", []), ("use crate::foo::{A, B as C, self};", ["A", "B"]), ("pub use crate::foo::Bar;", ["Bar"]), (None, None)],
)
def test_imported_names(spark, text, names):
    got = spark.range(1).select(L.imported_names(F.lit(text).cast("string")).alias("x")).first()["x"]
    assert (got or []) == (names or [])


def test_calls(spark):
    n = nodes(
        spark,
        node("from b import load_all, skip_me", "import"), node("caller", body="def caller():\n    load_all(1)\n    x.skip_me()\n"), node("load_all", file="b.py"), node("skip_me", file="b.py"),
        node("load_all", file="c.ts", language="typescript"), node("local_one", body="caller ()"),
    )
    assert pairs(L.import_calls(n)) == {("caller", "load_all", "calls")} and L.import_calls(n).count() == 1
    assert pairs(L.same_file_calls(n)) == {("local_one", "caller", "calls")}


def test_directory_modules(spark):
    n = nodes(spark, node("f", file="src/io/a.py"), node("g", file="main.rs"), node("m", "module"), node("e", root="external"), node("v", metadata={"virtual": "true"}))
    assert {r["target_id"] for r in L.directory_modules(n).collect()} == {"r:src/io:io:module", "r::main:module"}


def test_topics_events_and_boundaries(spark):
    body = "producer.send('orders', x)\nproducer.send('late')\ntask.delay(1)\nsocket.emit('joined'); io.on(\"connect\", f); socket.on('left')"
    n = nodes(spark, node("f", body=body), node("none", body=None), node("import kafka", "import"))
    assert pairs(L.topics(n, ["kafka-python"])) == {("f", "orders", "produces")}
    assert {r["target_id"] for r in L.topics(n, ["celery", "redis"]).collect()} == {"r:channels:celery:task:channel"}
    assert L.topics(n, []).collect() == []
    assert pairs(L.socket_events(n)) == {("f", "joined", "produces"), ("f", "left", "consumes")}
    config = {"language": "Python", "imports": ["kafka"], "pattern": "producer.*", "argument": 0, "edge_kind": "produces"}
    assert pairs(L.boundaries(n, [config])) == {("f", "orders", "produces"), ("f", "late", "produces")}
    assert L.boundaries(n, [config | {"imports": ["pika"]}]).collect() == [] == L.boundaries(n, []).collect()
    second = nodes(spark, node("g", body="bus.publish(client, 'topic-a')"))
    assert pairs(L.boundaries(second, [{"language": "python", "pattern": "bus.publish", "argument": 1, "edge_kind": "produces"}])) == {("g", "topic-a", "produces")}


@pytest.mark.parametrize(
    "file,path",
    [("app/api/v2/items/[...slug]/route.ts", "/api/v2/items/{slug}"), ("web/src/app/users/[id]/route.tsx", "/users/{id}"), ("app/route.ts", "/"), ("pages/api/index.ts", "/api"), ("pages/api/u/[id].js", "/api/u/{id}"), ("pages/api/x/[[...all]].ts", "/api/x/{all}"), ("pages/api/_x.ts", None), ("pages/api/a.test.ts", None), ("pages/home.ts", None), ("app/page.tsx", None)],
)
def test_file_routes(spark, file, path):
    got = [r["http_path"] for r in L.file_routes(spark.createDataFrame([("r", file)], "root string, file string")).collect()]
    assert got == ([path] if path else [])


def test_handlers_endpoints_and_rpc(spark):
    files = spark.createDataFrame([("r", "app/x/route.ts")], "root string, file string")
    n = nodes(spark, node("GET", file="app/x/route.ts"), node("helper", file="app/x/route.ts"))
    assert {r["target_id"] for r in L.route_handlers(files, n).collect()} == {"r:app/x/route.ts:GET /x:api_endpoint"}
    text = '// app.MapGet("/no", f)\napp.MapGet("/a", f); app.MapPost ( "/b", g)\napp.MapOther("/c")\n'
    got = L.minimal_endpoints(spark.createDataFrame([("r", "P.cs", text), ("r", "Q.cs", None)], "root string, file string, body string"))
    assert {(r["line"], r["method"], r["path"]) for r in got.collect()} == {(2, "GET", "/a"), (2, "POST", "/b")}
    rpc = nodes(spark, node("import x_pb2_grpc", "import"), node("f", body="stub.GetUser(r); stub.listAll(r)"), node("GetUser", file="u.proto", metadata={"parent_service": "U"}), node("ListAll", file="u.proto", metadata={"parent_service": "U"}), node("g", file="b.py", body="stub.GetUser(r)"))
    assert pairs(L.rpc_calls(rpc)) == {("f", "GetUser", "calls"), ("f", "ListAll", "calls")}


def test_outcomes_and_merges(spark):
    outcomes = spark.createDataFrame([("fast", ["src/io/*"]), ("none", [])], "outcome string, patterns array<string>")
    commits = spark.createDataFrame([("c1", "x [outcome:FAST]", ["z"]), ("c2", "y", ["src/io/a.py"]), ("c3", "[outcome:fast]", ["src/io/b.py"]), ("c4", "q", ["a"])], "hash string, message string, files array<string>")
    hits = L.outcome_commits(outcomes, commits)
    assert {(r["hash"], r["how"]) for r in hits.collect()} == {("c1", 0), ("c2", 1), ("c3", 0)}
    n = nodes(spark, node("f", file="src/io/a.py"), node("use", "import", "src/io/a.py"), node("g", file="other"))
    assert {r["id"] for r in L.outcome_symbols(hits, commits, n).collect()} == {"r:src/io/a.py:f:function"}
    merges = commits.selectExpr("hash as id", "files")
    assert pairs(L.merge_links(merges.withColumn("id", F.concat(F.lit("r:m:"), "id", F.lit(":pr_merge"))), n)) == {("c2", "f", "modified")}
    serves = spark.createDataFrame([("c4", "Fast")], "merge string, outcome string")
    assert {r["merge"] for r in L.outcome_merges(outcomes, merges, serves).collect()} == {"c2", "c3", "c4"}


def test_updates(spark):
    n = nodes(spark, node("f"), node("g", root="q"))
    assert L.dirty_only(n, None).count() == 2 and L.dirty_only(n, []).count() == 0 and L.dirty_only(n, ["q"]).count() == 1
    two = n.withColumn("batch", F.lit(1)).unionByName(n.withColumn("batch", F.lit(2)).withColumn("body", F.lit("new")))
    assert {r["body"] for r in L.newest_wins(two).collect()} == {"new"}
    assert L.url_links(n.where("false")).collect() == [] == L.test_links(n.where("false")).collect()
