"""The index build, the API and the command line end to end on a small repository."""

import os

import pytest
from pyspark.sql import functions as F

from skein.__main__ import main
from skein.operators import graph as G
from skein.plans import api, pipeline
from skein.sources.store import Store

FILES = {
    "app/main.py": 'from fastapi import FastAPI\nfrom app.trays import seal_tray\n\napp = FastAPI()\nrouter = APIRouter(prefix="/v1")\n\n@router.get("/trays/{id}")\ndef read_tray(id: int):\n    """Read one."""\n    return seal_tray(id)\n\ndef main():\n    read_tray(1)\n',
    "app/trays.py": "LIMIT = 3\n\ndef seal_tray(x):\n    if x and LIMIT:\n        return open_tray(x)\n    return None\n\ndef open_tray(x):\n    return seal_tray(x)\n",
    "tests/test_trays.py": "from app.trays import seal_tray\n\ndef test_seal_tray():\n    assert seal_tray(0) is None\n",
    "web/client.ts": "// Reads a tray.\nexport const readTray = (id: number) => fetch('/v1/trays/:id');\nexport { readTray as default };\n",
    "Program.cs": 'app.MapGet("/health", () => 1);\n', "package.json": '{"dependencies": {"react": "1"}}', "README.md": "# Trays\n\n## Use\nsee [x](docs/x.md)\n", "blob.bin": b"a\x00b", "node_modules/x.js": "no", "broken.json": "{",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tray-repo")
    for name, data in FILES.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}/s")
    assert main(["--store", store.path, "search", "x"], spark) == "nothing has been scanned"
    assert main(["--store", store.path, "scan", str(root)], spark) == "version 1"
    return store, pipeline.open_graph(store), next(r["root"] for r in pipeline.open_graph(store).nodes.select("root").distinct().collect())


def links(graph, kind):
    short = lambda i: i.split(":", 2)[2].rsplit(":", 1)[0]
    return {(short(r["source_id"]), short(r["target_id"])) for r in graph.edges.where(f"edge_type = '{kind}'").collect()}


def test_graph(built):
    _, g, root = built
    nodes = {(r["file"], r["name"], r["kind"]): r for r in g.nodes.collect()}
    assert not any(f.startswith("node_modules") or f == "blob.bin" for f, _, _ in nodes)
    assert nodes["app/main.py", "GET /trays/{id}", "api_endpoint"]["metadata"]["http_path"] == "/v1/trays/{id}"
    assert ("Program.cs", "GET /health", "api_endpoint") in nodes and nodes["app/trays.py", "seal_tray", "function"]["cyclomatic"] == 3
    assert nodes["web/client.ts", "readTray", "function"]["doc_comment"] == "Reads a tray."
    assert max(r["importance"] for r in nodes.values()) == 1.0 and nodes["app/trays.py", "seal_tray", "function"]["subsystem"] == "app"
    calls = links(g, "calls")
    assert ("read_tray", "seal_tray") in calls and ("seal_tray", "open_tray") in calls and ("main", "read_tray") in calls
    assert links(g, "tested_by") == {("test_seal_tray", "seal_tray")} and ("/v1/trays/:id", "GET /trays/{id}") in links(g, "depends_on")
    assert any(t.startswith("app/trays.py") or t == "trays" for s, t in links(g, "depends_on") if s == "from app.trays import seal_tray")
    assert {t for _, t in links(g, "re_exports")} == {"readTray"} and g.edges.where("target_id like 'external:npm:react%'").count() == 1
    assert g.edges.groupBy("id").count().where("count > 1").count() == 0


def test_api(built):
    _, g, root = built
    top = [r["name"] for r in api.search(g, "tray", kind="Function", limit=3).orderBy("place").collect()]
    assert len(top) == 3 and set(top) <= {"seal_tray", "open_tray", "read_tray", "readTray"}
    assert api.search(g, "seal_tray").orderBy("place").first()["name"] == "seal_tray"
    assert [r["name"] for r in api.search(g, sort_by="complexity", kind="function", limit=1).collect()] == ["seal_tray"]
    ids = lambda df: {r["id"].split(":")[2] for r in df.collect()}
    assert {"open_tray", "read_tray", "main"} <= ids(api.search(g, node="app/trays.py/seal_tray", mode="impact"))
    assert ids(api.search(g, node="seal_tray", mode="tests_for")) == {"test_seal_tray"}
    assert {"seal_tray", "open_tray"} <= ids(api.search(g, node="open_tray", mode="cycles"))
    assert [i.split(":")[2] for i in api.path(g, "main", "open_tray")] == ["read_tray", "seal_tray", "open_tray"] and api.path(g, "main", "nobody") is None
    assert ids(api.search(g, nodes=["app/trays.py:seal_tray:function", "none"])) == {"seal_tray"}
    assert ids(api.search(g, node="app/trays.py:seal_tray:function")) == {"seal_tray"}
    with pytest.raises(ValueError):
        api.search(g, node="seal_tray", mode="tests_for", edge_types=["calls"])
    with pytest.raises(ValueError):
        api.batch(g, ["x"], "neighbors", depth=2)
    parts = api.repo_map(g)
    assert parts["top_symbols"].count() > 0 and [r["name"] for r in parts["entry_points"].collect()] and parts["hotspots"].count() > 0
    assert api.impact_summary(G.reach(g.edges, g.nodes.where("name = 'seal_tray'").select("id"), 2, "incoming"), g.nodes) is None


def test_command_line(spark, built):
    store, _, root = built
    assert "seal_tray" in main(["--store", store.path, "search", "seal", "--limit", "3"], spark)
    assert "read_tray" in main(["--store", store.path, "graph", "seal_tray", "--mode", "impact"], spark)
    assert "## hotspots" in main(["--store", store.path, "repo-map"], spark) and root in main(["--store", store.path, "list-roots"], spark)


def test_merges_frameworks_and_vectors(spark, tmp_path):
    """A repository with a merge: its node, the symbols it modified, what the subsystem uses, and vectors that follow the symbols."""
    import subprocess

    root = tmp_path / "tray-repo"
    for name in ("app/main.py", "app/trays.py"):
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(FILES[name])
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-b", "main")
    git("add", "app/main.py")
    git("commit", "-m", "first")
    git("checkout", "-b", "trays")
    git("add", "app/trays.py")
    git("commit", "-m", "trays")
    git("checkout", "main")
    git("merge", "--no-ff", "trays", "-m", "Merge branch 'trays'\n[outcome:seal]")
    store = Store(spark, f"file://{tmp_path}/s")
    pipeline.build(spark, {"r": f"file://{root}"}, store, repos={"r": str(root)})
    g = pipeline.open_graph(store)
    merge = g.nodes.where("kind = 'pr_merge'").first()
    assert merge["name"] == "Merge branch 'trays'" and merge["metadata"]["branch"] == "trays" and merge["metadata"]["outcomes"] == "seal"
    changed = {r["target_id"].split(":")[2] for r in g.edges.where("edge_type = 'modified'").collect()}
    assert {"seal_tray", "open_tray", "LIMIT"} <= changed and "read_tray" not in changed
    uses = {tuple(r) for r in g.edges.where("edge_type = 'uses_framework'").select("source_id", "target_id").collect()}
    assert uses <= {("r:subsystems:app:subsystem", "r:frameworks:fastapi:framework")}
    first = pipeline.embed(store)
    assert first["embedded"] > 3 and first["deleted"] == first["kept"] == 0
    store.change(lambda s, e: (s.where("name <> 'open_tray'"), e))
    second = pipeline.embed(store)
    assert second["embedded"] == 0 and second["deleted"] == 1 and second["kept"] == first["embedded"] - 1


def test_search_by_vector_sections_and_subsystems(spark, built):
    from skein.operators import search as S

    _, g, root = built
    rows = S.index_rows(g.nodes)
    vectors = S.hashed_vectors(rows, "id", "text")
    asked = S.hashed_vectors(spark.createDataFrame([("q", "open tray seal")], "id string, text string"), "id", "text").withColumnRenamed("id", "query")
    hits = api.search(g, "tray", vectors=vectors, asked=asked, kind="function", limit=4).orderBy("place").collect()
    assert len(hits) == 4 and all(r["kind"] == "function" for r in hits) and [r["place"] for r in hits] == [1, 2, 3, 4]
    ranked = api.search(g, "tray", vectors=vectors, asked=asked, kind="function", limit=4, scorer=lambda q, t: float("open_tray" in t)).orderBy("place").first()
    assert "open_tray" in ranked["body"]
    artifacts = spark.createDataFrame([("a", "outcome", "Seal", "seal every tray"), ("b", "metis", "Note", "tray tray")], "id string, kind string, title string, text string")
    markdown = g.nodes.where("kind = 'markdown_section'").select("id", "name", F.lit(1).alias("level"), "body")
    parts = api.sections(g, "tray", artifacts, markdown, artifact_kinds=["outcome"])
    assert [r["id"] for r in parts["artifacts"].collect()] == ["a"] and parts["symbols"].count() > 0 and parts["markdown"].count() >= 1
    for mode in ("impact", "tests_for", "cycles"):
        with pytest.raises(ValueError):
            api.traverse(g, "seal_tray", mode, edge_types=["calls"])
    with pytest.raises(ValueError):
        api.traverse(g, "seal_tray", "sideways")
    assert api.traverse(g, "seal_tray", "impact", target_subsystem="nowhere").collect() == []
    assert api.traverse(g, "seal_tray", "impact", subsystem="APP").count() >= 2
