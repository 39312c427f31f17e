"""Repository files: scan, exclusion rules, roots, encodings and change detection."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import cut, spread

#: What is never scanned.
DEFAULT_EXCLUDES = ["node_modules/", ".git/", "target/", "build/", ".venv/", "venv/", "__pycache__/", ".pytest_cache/", "dist/", ".next/", "vendor/", "*.lock", "*.min.js", "*.map", "*.pyc"]
#: Bytes at a file's start in which a zero byte marks it as binary.
BINARY_HEAD = 8000
STATE = "root string, path string, modified timestamp, size bigint, sha256 string"


def excluded(path: Column, rules: list[str]) -> Column:
    """A directory name (x/, x*/), an ending (*.x), a prefix, or a whole path."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def begins(prefix):
        return lambda folder: folder.startswith(prefix)

    tests = []
    for rule in rules:
        if rule.endswith("*/"):
            tests.append(F.exists(folders, begins(rule[:-2])))
        elif rule.endswith("/") and "/" not in rule[:-1]:
            tests.append(F.array_contains(folders, rule[:-1]))
        elif rule.startswith("*."):
            tests.append(path.endswith(rule[1:]))
        else:
            tests.append((path == rule.rstrip("/")) | path.startswith(rule.rstrip("/") + "/"))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def scan(spark: SparkSession, roots: dict[str, str], excludes: list[str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """Root, path, modified, size, content of every file of the roots (slug to folder).

    Listing and reading are distributed; rules apply to the path below the root.
    """
    out = None
    for slug, folder in roots.items():
        base = re.sub(r"^file:/*", "/", folder).rstrip("/")
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        part = reader.load(folder).select(
            F.lit(slug).alias("root"), F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^{re.escape(base)}/", "").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content"
        )
        out = part if out is None else out.unionByName(part)
    out = out.where(~excluded(F.col("path"), DEFAULT_EXCLUDES if excludes is None else excludes))
    if extensions is not None:
        out = out.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([x.lower() for x in extensions]))
    return out


def listed(spark: SparkSession, roots: dict[str, str], excludes: list[str] | None = None) -> DataFrame:
    """Root, path, at (where it lies), modified, size of every file of the roots. No content is read. Empty files are not listed."""
    out = None
    for slug_, folder in roots.items():
        base = re.sub(r"^file:/*", "/", folder).rstrip("/")
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        name = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^{re.escape(base)}/", "")
        part = part.select(F.lit(slug_).alias("root"), name.alias("name"), F.col("path").alias("at"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")).withColumnRenamed("name", "path")
        out = part if out is None else out.unionByName(part)
    return out.where(~excluded(F.col("path"), DEFAULT_EXCLUDES if excludes is None else excludes))


def scan_changed(spark: SparkSession, roots: dict[str, str], state: DataFrame, excludes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new and changed files as ``scan`` gives them, the new state). Only files whose time or size differ from ``state`` are read.

    A file that was touched but holds what it held is no change; its new time is kept. Files that are gone leave the state.
    """
    now = listed(spark, roots, excludes)
    same = now.join(state.select("root", "path", "modified", "size", "sha256"), ["root", "path", "modified", "size"])
    differ = spread(now.join(state.select("root", "path", "modified", "size"), ["root", "path", "modified", "size"], "left_anti"))

    def read(batches):
        import pandas as pd
        from pyarrow.fs import FileSystem

        for batch in batches:
            for k in range(len(batch)):
                row = batch.iloc[k : k + 1]
                fs, path = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", row["at"].iloc[0]))
                with fs.open_input_stream(path) as f:
                    data = f.read()
                yield pd.DataFrame({**{c: row[c] for c in ("root", "path", "modified", "size")}, "content": [data]})

    read_ = cut(differ.mapInPandas(read, "root string, path string, modified timestamp, size bigint, content binary"), "changed_files")
    fresh = state_of(read_)
    known = fresh.join(state.select("root", "path", "sha256"), ["root", "path", "sha256"], "left_semi").select("root", "path")
    return read_.join(known, ["root", "path"], "left_anti"), same.select("root", "path", "modified", "size", "sha256").unionByName(fresh)


def decoded(files: DataFrame) -> DataFrame:
    """Adds binary, text (null for binary files) and replaced (whether bytes were not UTF-8)."""
    head = F.substring(F.hex(F.substring("content", 1, BINARY_HEAD)), 1, 2 * BINARY_HEAD)
    binary = F.size(F.filter(F.regexp_extract_all(head, F.lit("(..)"), F.lit(1)), lambda b: b == "00")) > 0
    text = F.decode("content", "UTF-8")
    valid = F.is_valid_utf8(F.col("content").cast("string")) if hasattr(F, "is_valid_utf8") else F.encode(text, "UTF-8") == F.col("content")
    made = F.make_valid_utf8(F.col("content").cast("string")) if hasattr(F, "make_valid_utf8") else text
    return files.withColumn("binary", binary).withColumn("text", F.when(~F.col("binary"), made)).withColumn("replaced", ~F.col("binary") & ~valid)


def state_of(files: DataFrame) -> DataFrame:
    """The scan state to keep: root, path, modified, size, sha256."""
    return files.select("root", "path", "modified", "size", F.sha2("content", 256).alias("sha256"))


def changes(files: DataFrame, state: DataFrame) -> DataFrame:
    """Root, path, change (new, changed, deleted) against a state. A touched file with the same content is no change."""
    now, old = state_of(files).withColumnRenamed("sha256", "now"), state.select("root", "path", F.col("sha256").alias("old"))
    both = now.join(old, ["root", "path"], "full")
    what = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("old"), "changed")
    return both.select("root", "path", what.alias("change")).where("change is not null")


def slug(path: str) -> str:
    """A root's name: its folder's, in lower case, other characters as dashes."""
    return re.sub(r"-+", "-", re.sub(r"[^a-z0-9]", "-", os.path.basename(os.path.abspath(path)).lower())).strip("-")


def resolve_roots(primary: str, worktrees: list[str] = (), declared: dict[str, str] | None = None, lsp_only: list[str] = ()) -> list[dict]:
    """Slug, path, kind of each root once; folders below another root are lsp_only and not extracted again."""
    roots = [{"slug": slug(primary), "path": os.path.abspath(primary), "kind": "code"}]
    roots += [{"slug": slug(w), "path": os.path.abspath(w), "kind": "worktree"} for w in worktrees]
    roots += [{"slug": name, "path": os.path.abspath(os.path.expanduser(p)), "kind": "declared"} for name, p in (declared or {}).items()]
    roots += [{"slug": slug(p), "path": os.path.abspath(p), "kind": "lsp_only"} for p in lsp_only]
    out: list[dict] = []
    for r in roots:
        if all(r["path"] != o["path"] and r["slug"] != o["slug"] for o in out):
            inside = any(r["path"].startswith(o["path"] + "/") for o in out if o["kind"] != "lsp_only")
            out.append(r | {"extract": r["kind"] != "lsp_only" and not inside})
    return out
