"""Files, markdown, history, extractors, the store and the stream."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from skein.sources import extract as X
from skein.sources import files as S
from skein.sources import history as H
from skein.sources import markdown as M
from skein.sources.store import Store
from skein.streaming import incremental as I


def write(root, files):
    for name, data in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())


def test_scan_rules_and_changes(spark, tmp_path):
    root = str(tmp_path / "repo")
    write(root, {"a.py": "x = 1\n", "node_modules/x/b.py": "no", "src/c.min.js": "no", "src/d.py": b"a\x00b", "src/e.py": "\xff".encode("latin-1"), "f.txt": "t"})
    found = S.scan(spark, {"r": f"file://{root}"}, extensions=["py", "js"])
    assert {r["path"] for r in found.collect()} == {"a.py", "src/d.py", "src/e.py"}
    text = {r["path"]: (r["binary"], r["replaced"], r["text"]) for r in S.decoded(found).collect()}
    assert text["a.py"] == (False, False, "x = 1\n") and text["src/d.py"][0] and text["src/e.py"][1]
    state = spark.createDataFrame(S.state_of(found).collect(), S.STATE.replace("sha256 string", "sha256 string"))
    os.utime(os.path.join(root, "a.py"), (1, 1))
    write(root, {"src/e.py": "new", "g.py": "g"})
    os.remove(os.path.join(root, "src/d.py"))
    again = S.scan(spark, {"r": f"file://{root}"}, extensions=["py", "js"])
    assert {(r["path"], r["change"]) for r in S.changes(again, state).collect()} == {("src/e.py", "changed"), ("g.py", "new"), ("src/d.py", "deleted")}


@pytest.mark.parametrize("path,rule,hit", [("a/target/b", "target/", True), ("target", "target/", False), ("a/venv3/b", "venv*/", True), ("a.lock", "*.lock", True), ("docs/x/y", "docs/x", True), ("docs/xy", "docs/x", False)])
def test_exclusion_rules(spark, path, rule, hit):
    assert spark.range(1).select(S.excluded(F.lit(path), [rule])).first()[0] is hit


def test_roots(tmp_path):
    roots = S.resolve_roots(str(tmp_path / "My Repo"), [str(tmp_path / "wt")], {"notes": str(tmp_path / "My Repo/sub")}, [str(tmp_path / "My Repo/x")])
    assert [(r["slug"], r["extract"]) for r in roots] == [("my-repo", True), ("wt", True), ("notes", False), ("x", False)]


MD = "---\ntitle: \"T\"\ntags:\n  - a\n---\nIntro `x`.\n\n# One\ntext [l](../b.md#q) ![i](i.png)\n\n## Two\n```\n# not a heading\n`no`\n```\n`code` [e](https://x.md)\n# Three #\n"


def test_markdown_chunks(spark):
    parts = M.chunks(MD)
    assert [(c["heading_level"], c["heading_text"], c["parent_heading"], c["is_frontmatter"]) for c in parts] == [(0, "", None, True), (0, "", None, False), (1, "One", None, False), (2, "Two", "One", False), (1, "Three", None, False)]
    assert parts[3]["heading_hierarchy"] == ["# One", "## Two"] and parts[3]["code_spans"] == ["code"] and sum(c["byte_len"] for c in parts) == len(MD.encode())
    assert M.fields(M.frontmatter(MD)[0]) == {"title": "T", "tags": "- a"} and M.frontmatter("---\nopen") == (None, 0)
    df = M.markdown_chunks(spark.createDataFrame([("docs/a/x.md", MD), ("e.md", ""), ("n.md", None)], "file_path string, text string"))
    assert {(r["parent"], r["child"]) for r in M.hierarchy_edges(df).collect()} == {("One", "Two")}
    assert {r["target"] for r in M.link_edges(df).collect()} == {"docs/b.md"}


def test_artifacts(spark, tmp_path):
    H.write_artifact(str(tmp_path), "outcome", "Be fast", {"id": "fast", "status": "open"}, "Body")
    write(str(tmp_path), {"signals/bad.md": b"\xff\xfe", "outcomes/plain.md": "no front"})
    rows = {r["id"]: r for r in H.artifacts(spark, str(tmp_path)).collect()}
    assert set(rows) == {"fast", "plain"} and rows["fast"]["frontmatter"]["status"] == "open" and rows["fast"]["body"] == "Body"


def test_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-qb", "main")
    for k, name in enumerate(("a.py", "b.py")):
        write(str(tmp_path), {name: str(k)})
        git("add", "-A")
        git("commit", "-qm", f"Add {name} [outcome:o{k}]")
    git("checkout", "-qb", "side", "HEAD~1")
    write(str(tmp_path), {"c.py": "c"})
    git("add", "-A")
    git("commit", "-qm", "Side")
    git("checkout", "-q", "main")
    git("merge", "-q", "--no-ff", "-m", "Merge branch 'side' into main\n\n[outcome:m]", "side")
    log = H.commits(spark, str(tmp_path))
    assert log.count() == 3 and H.search_commits(log, "ADD B", 5).first()["files"] == ["b.py"] and H.file_history(log, "a.py", 5).count() == 1
    m = H.merges(log).collect()
    assert [(r["branch"], r["outcomes"], r["files"]) for r in m] == [("side", ["m"], ["c.py"])]


def test_manifests(spark):
    rows = [("r", "package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}'), ("r", "a/pyproject.toml", '[project]\ndependencies = ["httpx>=1", "numpy"]\n'), ("r", "requirements.txt", "flask==1 # x\n-r other\n"), ("r", "go.mod", "module m\nrequire (\n\tgithub.com/a/b v1\n)\nrequire x.y/z v2\n"), ("r", "a/b/c/package.json", '{"dependencies": {"deep": "1"}}'), ("r", "b/package.json", "{broken"), ("r", "c/package.json", None)]
    got = H.manifest_packages(spark.createDataFrame(rows, "root string, path string, text string"))
    assert {r["package"] for r in got.collect()} == {"react", "jest", "httpx", "numpy", "flask", "github.com/a/b", "x.y/z"}


def test_scan_reads_what_differs_only(spark, tmp_path):
    root = tmp_path / "r"
    write(str(root), {"a.py": "A = 1\n", "b/c.py": "C = 1\n", "node_modules/x.js": "no", "d.py": "D", "empty.py": ""})
    roots, none = {"r": f"file://{root}"}, spark.createDataFrame([], S.STATE)
    first, state = S.scan_changed(spark, roots, none)
    assert {(r["path"], bytes(r["content"])) for r in first.collect()} == {("a.py", b"A = 1\n"), ("b/c.py", b"C = 1\n"), ("d.py", b"D")}
    kept = spark.createDataFrame(state.collect(), S.STATE)
    again, _ = S.scan_changed(spark, roots, kept)
    assert again.collect() == []
    write(str(root), {"a.py": "A = 22\n", "e.py": "E = 1\n"})
    os.utime(root / "b/c.py", (1, 1))  # touched, not changed
    os.remove(root / "d.py")
    third, state = S.scan_changed(spark, roots, kept)
    assert {r["path"] for r in third.collect()} == {"a.py", "e.py"}
    assert {r["path"] for r in state.collect()} == {"a.py", "b/c.py", "e.py"}


def test_boundary_configs(tmp_path):
    write(str(tmp_path), {"a.toml": '[meta]\nname = "x"\n[meta.applies_when]\nlanguage = "python"\nimports_contain = ["bus"]\n[[boundaries]]\nfunction_pattern = "bus.publish"\narg_position = 1\nedge_kind = "Produces"\n', "b.toml": "broken ["})
    assert H.boundary_configs(str(tmp_path)) == [{"language": "python", "imports": ["bus"], "pattern": "bus.publish", "argument": 1, "decorator": False, "edge_kind": "produces"}] and H.boundary_configs(str(tmp_path / "no")) == []


def rows(file, text, what="node"):
    return {(r[3], r[4] or r[12]) for r in X.extract_file("r", file, text) if r[0] == what}


PY = '"""m"""\nimport os\nfrom a.b import C\nLIMIT = 3\n\n@app.get("/x/{id}")\nasync def read(a: Tray) -> Lane:\n    """Doc."""\n    if a and a.b or 1:\n        return [x for x in a]\n    def inner():\n        if 1: pass\n\nclass TrayFactory(Base):\n    size: int = 0\n    @staticmethod\n    def test_it(): pass\n'


def test_python_extractor():
    made = {r[3]: r for r in X.extract_file("r", "src/m.py", PY) if r[0] == "node"}
    assert {"m", "import os", "from a.b import C", "LIMIT", "read", "inner", "TrayFactory", "size", "test_it", "GET /x/{id}"} <= set(made)
    meta = made["read"][10]
    assert meta["cyclomatic"] == "5" and meta["is_async"] == "true" and meta["doc_comment"] == "Doc." and meta["decorators"] == "app.get('/x/{id}')"
    assert made["test_it"][10]["is_static"] == "true" and made["test_it"][10]["is_test"] == "true" and made["TrayFactory"][10]["pattern_hint"] == "factory"
    kinds = {(r[3].split(":")[-2], r[11].split(":")[-2], r[12]) for r in X.extract_file("r", "src/m.py", PY) if r[0] == "edge"}
    assert {("read", "Tray", "depends_on"), ("read", "Lane", "depends_on"), ("TrayFactory", "Base", "implements"), ("TrayFactory", "size", "has_field"), ("read", "GET /x/{id}", "implements"), ("from a.b import C", "a.b", "depends_on")} <= kinds
    broken = X.extract_file("r", "b.py", "def ok(x):\n    return x\n\nclass (:\n")
    assert ("ok", "function") in {(r[3], r[4]) for r in broken}


@pytest.mark.parametrize(
    "file,text,want",
    [
        ("a.rs", "use a::B;\npub struct Tray { x: u8 }\nimpl Seal for Tray { fn seal(&self) { if x && y {} } }\n#[test]\nfn t() {}\nconst N: u8 = 1;\n", {("Tray", "struct"), ("seal", "function"), ("t", "function"), ("N", "const"), ("use a::B;", "import")}),
        ("a.go", "package p\nimport \"fmt\"\nimport (\n\t\"os\"\n)\ntype T struct {}\ntype I interface {}\nconst C = 1\nfunc (t *T) M(a int) error { return nil }\n", {("T", "struct"), ("I", "trait"), ("M", "function"), ("C", "const"), ('"os"', "import")}),
        ("a.java", "import a.B;\npublic class Foo extends Bar {\n  static final int N = 1;\n  @Test public void m(int a) { }\n}\n", {("Foo", "struct"), ("m", "function"), ("N", "const"), ("import a.B;", "import")}),
        ("a.ts", "import { A } from './a';\nexport interface I { }\nexport const f = (x: number): number => x;\nclass K { go() { } }\nconst N = 3;\nrouter.get('/u/:id', f);\n", {("I", "trait"), ("f", "function"), ("go", "function"), ("K", "struct"), ("N", "const"), ("GET /u/:id", "api_endpoint")}),
        ("a.cs", "using System;\nnamespace N { public class Foo { public async Task<int> Do(int x) { return 2; } } }", {("Foo", "struct"), ("Do", "function"), ("using System;", "import")}),
        ("a.kt", "class A\nfun hello(x: Int): Int { return x }", {("hello", "function")}), ("a.swift", "struct S { }\nfunc go(_ x: Int) -> Int { return x }", {("S", "struct"), ("go", "function")}), ("a.rb", "class A\n  def foo(x)\n  end\nend", {("A", "struct"), ("foo", "function")}),
        ("a.sh", "NAME=1\ngo() {\n  echo\n}\n", {("go", "function"), ("NAME", "const")}), ("a.c", "#include <x.h>\n#define M 3\nint main(void) { return 0; }", {("main", "function"), ("M", "const")}), ("a.ex", "defmodule A do\n  def run(x) do\n  end\nend", {("run", "function")}), ("a.lua", "function go(x)\nend", {("go", "function")}), ("a.php", "<?php function go($x) { }", {("go", "function")}),
        ("a.sql", "create table if not exists t (id int primary key, u_id int references u(id), foreign key (a) references b(c));\ncreate type c as enum ('x', 'y');", {("t", "sql_table"), ("t.id", "sql_column"), ("t.u_id", "sql_column"), ("c", "enum"), ("x", "enum_variant")}),
        ("a.proto", "service S { rpc GetUser(Req) returns (stream Res); }\nmessage Req { string id = 1; }", {("S", "proto_service"), ("GetUser", "function"), ("Req", "proto_message"), ("Req.id", "proto_field")}),
        ("a.graphql", "type A implements B { x: [C!] }\nenum E { P Q }", {("A", "graphql_type"), ("A.x", "field"), ("E.P", "enum_variant")}), ("Dockerfile", "FROM a AS b\nEXPOSE 80\nFROM b", {("b", "dockerfile_from"), ("80", "dockerfile_port")}),
        ("a.yaml", "apiVersion: v1\nkind: Pod\nmetadata:\n  name: p\n", {("Pod/p", "yaml_key"), ("kind", "yaml_key")}), ("o.yaml", "openapi: 3\npaths:\n  /x:\n    get:\n      operationId: getX\ncomponents:\n  schemas:\n    Tray:\n      type: object\n", {("GET /x", "api_endpoint"), ("Tray", "struct")}),
        ("o.json", '{"openapi": "3", "paths": {"/x": {"post": {"operationId": "p"}}}, "components": {"schemas": {"T": {"properties": {"a": {}}}}}}', {("POST /x", "api_endpoint"), ("T", "struct"), ("T.a", "schema_field")}), ("a.json", '{"a": 1}', {("a", "json_key")}), ("a.toml", "[a.b]\nc = 1\n", {("a.b", "toml_key"), ("c", "toml_key")}),
        ("a.html", '<div id="q"></div><script src="z.js"></script><template id="t"></template>', {("q", "html_id"), ("z.js", "html_script"), ("t", "html_template")}), ("m.tf", 'resource "aws_x" "y" {\n a = var.z\n}', {("aws_x.y", "tf_resource")}), ("a.md", "# A\n## B\n", {("A", "markdown_section"), ("B", "markdown_section")}), ("a.unknown", "x", set()), ("a.py", "", set()),
    ],
)
def test_extractors(file, text, want):
    assert want <= rows(file, text) and not rows(file, text, "error")


def test_extract_isolates_errors_and_literals(spark):
    files = spark.createDataFrame([("r", "a.json", None, "{broken"), ("r", "b.py", None, "X = 'long one'\nY = 'long one'\nZ = 'ab'\n"), ("r", "c.py", None, None), (None, None, "python", "Q = 1\n")], "root string, file string, language string, body string")
    got = X.extract(files)
    assert {(r["file"], r["name"]) for r in got.where("what = 'error'").collect()} == {("a.json", "JSONDecodeError")}
    lits = got.where("metadata['synthetic'] = 'true'").collect()
    assert [(r["name"], r["line_start"]) for r in lits] == [("long one", 1)]
    assert X.nodes_of(got).groupBy("id").count().where("count > 1").count() == 0


SYM = "id string, root_id string, file_path string, name string"
EDG = "id string, source_id string, target_id string, edge_type string, root_id string"


def tables(spark, names, file="a.py", root="r"):
    s = spark.createDataFrame([(f"{root}:{file}:{n}:function", root, file, n) for n in names], SYM)
    e = spark.createDataFrame([(f"{root}:{file}:{n}:function->calls->x", f"{root}:{file}:{n}:function", "x", "calls", root) for n in names], EDG)
    return s, e


def test_store_versions_upsert_and_roots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.version == 0 and store.load("symbols") is None
    assert store.persist(*tables(spark, ["f", "g"])) == 1
    other, edges = tables(spark, ["f"], root="q")
    assert store.upsert(other, edges, other.where("false")) == 2
    gone = spark.createDataFrame([("r", "a.py")], "root_id string, file_path string")
    assert store.upsert(*tables(spark, ["h"]), gone) == 3
    assert {r["id"] for r in store.load("symbols").collect()} == {"r:a.py:h:function", "q:a.py:f:function"} and store.load("edges").count() == 2
    assert store.load("symbols", 2).count() == 3 and store.sentinel()["counts"] == {"symbols": 2, "edges": 2}
    assert sorted(os.listdir(f"{tmp_path}/s/pointers"))[-2:] == [x for x in sorted(os.listdir(f"{tmp_path}/s/pointers")) if x.isdigit()]
    assert store.remove_roots(["q"]) == 4 and [r["root_id"] for r in store.roots().collect()] == ["r"]
    assert not store._commit(4, {"data": {}}, {})
    store.folder.delete("schema.json")
    store.folder.create("schema.json", {"schema_version": 0})
    assert store.migrate() and store.version == 0


def test_two_upserts_at_once_lose_nothing(spark, tmp_path):
    a, b = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    none = spark.createDataFrame([], "root_id string, file_path string")
    a.persist(*tables(spark, ["f"]))
    write, raced = Store._data, []

    def overtaken(self, *made):
        out = write(self, *made)
        if self is a and not raced:
            raced.append(b.upsert(*tables(spark, ["by_b"], "b.py"), none))
        return out

    a._data = overtaken.__get__(a)
    assert a.upsert(*tables(spark, ["by_a"], "a2.py"), none) == 3 and raced == [2]
    assert {r["name"] for r in b.load("symbols").collect()} == {"f", "by_a", "by_b"} and b.load("edges").count() == 3
    assert a.folder.names("pointers") == ["000000000002", "000000000003"]


@pytest.mark.parametrize("step", ["_write", "_publish"])
def test_store_survives_a_death_before_its_commit(spark, tmp_path, monkeypatch, step):
    store = Store(spark, f"file://{tmp_path}/s")
    store.persist(*tables(spark, ["f"]))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(type(store.folder), step, die)
        with pytest.raises(KeyboardInterrupt):
            store.persist(*tables(spark, ["g"]))
    again = Store(spark, store.path)
    assert again.version == 1 and [r["name"] for r in again.load("symbols").collect()] == ["f"]
    assert again.persist(*tables(spark, ["h"])) == 2


def test_missing_roots_are_removed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert I.remove_missing_roots(store, ["r"]) == 0
    store.persist(*tables(spark, ["f"]))
    store.upsert(*tables(spark, ["f"], root="q"), spark.createDataFrame([], "root_id string, file_path string"))
    assert I.remove_missing_roots(store, ["q", "r"]) == 2
    assert I.remove_missing_roots(store, ["q"]) == 3 and [r["root_id"] for r in store.roots().collect()] == ["q"]


def test_stream_batches_give_the_full_result(spark, tmp_path):
    """Any split into micro-batches gives the same tables; a batch that comes again changes nothing."""
    row = lambda f, body, deleted=False: ("r", f, None, body, deleted)
    first = [row("a.py", "def f(): pass\n"), row("b.py", "def g(): pass\n")]
    second = [row("a.py", "def f2(): pass\n"), row("b.py", None, True), row("c.py", "def h(): pass\n")]
    store = Store(spark, f"file://{tmp_path}/stream")
    for k, part in enumerate((first, second)):
        spark.createDataFrame(part, I.FILES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        query = I.index_stream(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/cp")
        query.awaitTermination()
        assert store.version == k + 1
    names = {r["name"] for r in store.load("symbols").where("kind = 'function'").collect()}
    assert names == {"f2", "h"}
    assert I.apply_batch(store, spark.createDataFrame(first, I.FILES), 1) == 2 and store.version == 2
    whole = Store(spark, f"file://{tmp_path}/whole")
    I.apply_batch(whole, spark.createDataFrame([second[0], second[2]], I.FILES), 0)
    for name in ("symbols", "edges"):
        assert {r["id"] for r in whole.load(name).collect()} == {r["id"] for r in store.load(name).collect()}


def test_refresh_after_batches_equals_one_over_everything(spark, tmp_path):
    row = lambda f, body, deleted=False: ("r", f, None, body, deleted)
    calls = "from lib import seal_tray\n\ndef use():\n    return seal_tray(1)\n"
    first = [row("a.py", calls), row("lib.py", "def seal_tray(x):\n    return x\n"), row("tests/t.py", "def test_seal_tray():\n    pass\n")]
    second = [row("lib.py", "def seal_tray(x):\n    return x\n\ndef other_one():\n    return seal_tray(2)\n"), row("tests/t.py", None, True)]
    parts, whole = (Store(spark, f"file://{tmp_path}/{n}") for n in ("parts", "whole"))
    for k, part in enumerate((first, second)):
        I.apply_batch(parts, spark.createDataFrame(part, I.FILES), k)
        I.refresh(parts)
    I.apply_batch(whole, spark.createDataFrame([first[0], second[0]], I.FILES), 0)
    I.refresh(whole)
    edges = lambda s: {(r["id"], r["edge_source"]) for r in s.load("edges").collect()}
    rank = lambda s: {r["id"]: round(r["importance"], 9) for r in s.load("symbols").collect()}
    assert edges(parts) == edges(whole) and rank(parts) == rank(whole)
    assert ("r:a.py:use:function->calls->r:lib.py:seal_tray:function", "pass") in edges(parts) and not any("tested_by" in i for i, _ in edges(parts))


def test_long_heads_are_functions_too():
    """No window behind or before a definition: long type lists, throws clauses, return types and modifiers."""
    from skein.sources import lexing

    throws = ", ".join(f"Exception{i}" for i in range(400))
    java = f"class A {{\n  public {'Map<String, ' * 60}X{'>' * 60} get(int a) throws {throws} {{ return null; }}\n  void next() {{ }}\n}}\n"
    assert [f.name for f in lexing.functions(lexing.read(java, "java"))] == ["get", "next"]
    types = ", ".join(f"T{i} extends {{ a: string; b{i}: number }}" for i in range(300))
    script = f"export const go = <{types}>(x: T1): {'Array<' * 200}T1{'>' * 200} => {{ return [x]; }};\nclass K {{\n  run(a: number): {{ {' '.join(f'k{i}: string,' for i in range(200))} }} {{ return 1; }}\n}}\nconst no = a < b;\n"
    assert [f.name for f in lexing.functions(lexing.read(script, "javascript"))] == ["go", "run"]
    rust = f"fn wide<{', '.join(f'A{i}: Fn(u8) -> u8' for i in range(300))}>(x: A1) -> A1 {{ x }}\n"
    assert [f.name for f in lexing.functions(lexing.read(rust, "rust"))] == ["wide"]
