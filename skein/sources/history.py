"""Artifacts, commits, merges, manifests and boundary configs."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.functions import predicates as P
from skein.sources.markdown import fields, frontmatter

#: Artifact folders and kinds.
ARTIFACT_KINDS = {"outcomes": "outcome", "signals": "signal", "guardrails": "guardrail", "metis": "metis"}
ARTIFACTS = "kind string, file_path string, id string, frontmatter map<string,string>, body string"
COMMITS = "hash string, short_hash string, message string, author string, timestamp bigint, parents array<string>, files array<string>"
DEPENDENCIES = "root string, manifest string, package string, ecosystem string"


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts in the kind folders below ``folder``; missing folders and files that aren't text are skipped."""
    rows = []
    for sub, kind in ARTIFACT_KINDS.items():
        place = os.path.join(folder, sub)
        for name in sorted(os.listdir(place)) if os.path.isdir(place) else []:
            if name.endswith(".md"):
                try:
                    with open(os.path.join(place, name), encoding="utf-8") as f:
                        text = f.read()
                except (OSError, UnicodeDecodeError):
                    continue
                front, end = frontmatter(text)
                meta = fields(front) if front else {}
                rows.append((kind, f"{sub}/{name}", meta.get("id") or name[:-3], meta, text[end:].strip()))
    return spark.createDataFrame(rows, ARTIFACTS)


def write_artifact(folder: str, kind: str, name: str, meta: dict, body: str) -> str:
    """Write or replace one artifact; its path."""
    sub = next(s for s, k in ARTIFACT_KINDS.items() if k == kind)
    os.makedirs(os.path.join(folder, sub), exist_ok=True)
    path = os.path.join(folder, sub, f"{re.sub(r'[^A-Za-z0-9_-]+', '-', name)}.md")
    front = "".join(f"{k}: {v}\n" for k, v in meta.items())
    with open(path + ".part", "w", encoding="utf-8") as f:
        f.write(f"---\n{front}---\n\n{body.strip()}\n")
    os.replace(path + ".part", path)
    return path


def commits(spark: SparkSession, repo: str, limit: int | None = None) -> DataFrame:
    """The commits of a git repository, newest first, with the files each changed against its first parent."""
    args = ["git", "-C", repo, "log", "--topo-order", "-m", "--first-parent", "--name-only", "--format=%x01%H%x02%h%x02%an%x02%at%x02%P%x02%B%x03"]
    if limit:
        args.append(f"-n{limit}")
    text = subprocess.run(args, capture_output=True, text=True, check=True).stdout
    rows = []
    for part in text.split("\x01")[1:]:
        head, _, names = part.partition("\x03")
        full, short, author, at, parents, message = head.split("\x02", 5)
        rows.append((full, short, message.strip(), author, int(at), parents.split(), sorted({x for x in names.split("\n") if x.strip()})))
    return spark.createDataFrame(rows, COMMITS)


def search_commits(df: DataFrame, text: str, limit: int) -> DataFrame:
    """The newest commits whose message contains a text, ignoring case."""
    return df.where(F.lower("message").contains(text.lower())).orderBy(F.desc("timestamp"), "hash").limit(limit)


def file_history(df: DataFrame, path: str, limit: int) -> DataFrame:
    """The newest commits that changed a file."""
    return df.where(F.array_contains("files", path)).orderBy(F.desc("timestamp"), "hash").limit(limit)


def changed_between(df: DataFrame, old: str, new: str) -> DataFrame:
    """The files of the first-parent commits after ``old`` up to ``new``."""
    order = df.select("hash", "timestamp", "files")
    low = order.where(F.col("hash") == old).select("timestamp").scalar()
    high = order.where(F.col("hash") == new).select("timestamp").scalar()
    return order.where((F.col("timestamp") > low) & (F.col("timestamp") <= high)).select(F.explode("files").alias("file")).distinct()


def merges(df: DataFrame) -> DataFrame:
    """Commits of two or more parents: hash, title, branch, outcomes, files, timestamp."""
    m = df.where(F.size("parents") >= 2)
    return m.select("hash", F.split_part("message", F.lit("\n"), F.lit(1)).alias("title"), P.branch_name("message").alias("branch"), P.outcome_tags("message").alias("outcomes"), "files", "timestamp")


def _python_name(spec: str) -> str:
    m = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)", spec)
    return m[1] if m else ""


def dependencies(path: str, text: str) -> list[tuple[str, str]]:
    """(package, ecosystem) a manifest names; [] for others and for broken ones."""
    name = path.rsplit("/", 1)[-1]
    out: list[tuple[str, str]] = []
    try:
        if name == "package.json":
            data = json.loads(text)
            out = [(p, "npm") for key in ("dependencies", "devDependencies", "peerDependencies") for p in data.get(key) or {}]
        elif name == "pyproject.toml":
            data = tomllib.loads(text)
            project = data.get("project", {})
            specs = [*project.get("dependencies", []), *[s for v in project.get("optional-dependencies", {}).values() for s in v]]
            out = [(_python_name(s), "pypi") for s in specs] + [(p, "pypi") for p in data.get("tool", {}).get("poetry", {}).get("dependencies", {}) if p != "python"]
        elif re.fullmatch(r"requirements[\w.-]*\.txt", name):
            out = [(_python_name(s.split("#")[0]), "pypi") for s in text.splitlines() if s.strip() and not s.lstrip().startswith(("#", "-"))]
        elif name == "go.mod":
            for block in re.findall(r"(?m)^require\s*\(([^)]*)\)", text):
                out += [(line.split()[0], "go") for line in block.splitlines() if line.strip() and not line.strip().startswith("//")]
            out += [(m, "go") for m in re.findall(r"(?m)^require\s+([^\s(]+)\s+v", text)]
    except (ValueError, AttributeError, TypeError):
        return []
    return sorted({x for x in out if x[0]})


def manifest_packages(files: DataFrame, depth: int = 2) -> DataFrame:
    """Root, manifest, package, ecosystem of manifests at most ``depth`` folders deep. files: root, path, text."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = [(r, p, d, e) for r, p, t in zip(batch["root"], batch["path"], batch["text"], strict=True) for d, e in dependencies(p, t)]
            yield pd.DataFrame(rows, columns=["root", "manifest", "package", "ecosystem"])

    names = F.element_at(F.split("path", "/"), -1).rlike(r"^(?:package\.json|pyproject\.toml|requirements[\w.-]*\.txt|go\.mod)$")
    deep = F.size(F.split("path", "/")) - 1 <= depth
    return files.where(names & deep & F.col("text").isNotNull()).select("root", "path", "text").mapInPandas(run, DEPENDENCIES)


def boundary_configs(folder: str) -> list[dict]:
    """The boundary configs in TOML files of a folder, one for each boundary; broken files are skipped."""
    out = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if not name.endswith(".toml"):
            continue
        try:
            with open(os.path.join(folder, name), "rb") as f:
                data = tomllib.load(f)
            gate = data["meta"]["applies_when"]
            for b in data["boundaries"]:
                kind = b["edge_kind"]
                out.append({"language": gate["language"], "imports": gate.get("imports_contain", []), "pattern": b["function_pattern"], "argument": b.get("topic_arg", b.get("arg_position", 0)), "decorator": b.get("decorator", False), "edge_kind": {"Produces": "produces", "Consumes": "consumes"}.get(kind, kind)})
        except (OSError, ValueError, KeyError, TypeError):
            continue
    return out


def latest_per_file(df: DataFrame) -> DataFrame:
    """The newest commit of each file: file, hash, timestamp."""
    w = W.partitionBy("file").orderBy(F.desc("timestamp"), "hash")
    return df.select(F.explode("files").alias("file"), "hash", "timestamp").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
