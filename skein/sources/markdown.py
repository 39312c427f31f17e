"""Markdown files as chunks, and their links."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = (
    "file_path string, heading_hierarchy array<string>, heading_level int, heading_text string, parent_heading string, is_frontmatter boolean, content string, "
    "byte_offset bigint, byte_len bigint, code_spans array<string>, links array<struct<text:string,dest:string>>"
)
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^[ \t]{0,3}(```+|~~~+)")
_SPAN = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
_LINK = re.compile(r"(?<!!)\[([^\]\n]*)\]\(\s*<?([^)\s>]+)>?[^)\n]*\)")


def frontmatter(text: str) -> tuple[str | None, int]:
    """The text between the opening and closing --- lines, and the offset behind; (None, 0) without them."""
    if not re.match(r"---[ \t]*\r?\n", text):
        return None, 0
    close = re.compile(r"^(?:---|\.\.\.)[ \t]*\r?$", re.M).search(text, text.index("\n") + 1)
    if not close:
        return None, 0
    end = text.find("\n", close.start())
    return text[text.index("\n") + 1 : close.start()], end + 1 if end >= 0 else len(text)


def fields(front: str) -> dict[str, str]:
    """Top-level key: value pairs of a front matter; nested lines join their key's value."""
    out: dict[str, str] = {}
    key = None
    for line in front.splitlines():
        if m := re.match(r"([\w.-]+)[ \t]*:[ \t]*(.*)$", line):
            key = m[1]
            out[key] = m[2].strip().strip("\"'")
        elif key and line.strip():
            out[key] = (out[key] + "\n" + line.strip()).strip()
    return out


def chunks(text: str | None) -> list[dict]:
    """The sections of a text: front matter, the part before the first heading, and one for each heading with its own content."""
    if not text:
        return []
    front, start = frontmatter(text)
    cuts, fence, at = [], None, start
    for line in text[start:].splitlines(keepends=True):
        if m := _FENCE.match(line):
            fence = None if fence and m[1].startswith(fence) else fence or m[1]
        elif fence is None and (m := _HEADING.match(line.rstrip("\r\n"))):
            cuts.append((at, at + len(line), len(m[1]), m[2]))
        at += len(line)
    parts = []
    if front is not None:
        parts.append((0, start, 0, start, 0, "", True))
    first = cuts[0][0] if cuts else len(text)
    if text[start:first].strip():
        parts.append((start, first, start, first, 0, "", False))
    for k, (a, body, level, title) in enumerate(cuts):
        end = cuts[k + 1][0] if k + 1 < len(cuts) else len(text)
        parts.append((a, end, body, end, level, title, False))
    out, stack = [], []
    for a, end, body, stop, level, title, is_front in parts:
        if level:
            while stack and stack[-1][0] >= level:
                stack.pop()
            parent = stack[-1][1] if stack else None
            stack.append((level, title))
        else:
            parent = None
        content = front if is_front else text[body:stop].strip("\r\n")
        plain = re.sub(r"(?ms)^[ \t]{0,3}(```+|~~~+).*?(?:^[ \t]{0,3}\1[^\n]*$|\Z)", "", text[a:end]) if not is_front else ""
        out.append(
            {
                "heading_hierarchy": [f"{'#' * lv} {t}" for lv, t in stack] if level else [],
                "heading_level": level,
                "heading_text": title,
                "parent_heading": parent,
                "is_frontmatter": is_front,
                "content": content,
                "byte_offset": len(text[:a].encode()),
                "byte_len": len(text[a:end].encode()),
                "code_spans": _SPAN.findall(plain),
                "links": [{"text": t, "dest": d} for t, d in _LINK.findall(plain)],
            }
        )
    return out


def markdown_chunks(files: DataFrame) -> DataFrame:
    """Chunks of files (file_path, text); null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.split(r", (?=\w+ )", CHUNKS)]
        for batch in batches:
            rows = [{"file_path": f} | c for f, t in zip(batch["file_path"], batch["text"], strict=True) for c in chunks(t)]
            yield pd.DataFrame(rows, columns=names)

    return files.where("text <> ''").select("file_path", "text").mapInPandas(run, CHUNKS)


def hierarchy_edges(parts: DataFrame) -> DataFrame:
    """file_path, parent, child: a section defines the sections right below it (by heading text)."""
    return parts.where("parent_heading is not null and heading_text <> ''").select("file_path", F.col("parent_heading").alias("parent"), F.col("heading_text").alias("child")).distinct()


def link_edges(parts: DataFrame) -> DataFrame:
    """file_path, heading_text, target: relative links to markdown files, resolved against the file's folder."""

    @F.pandas_udf("string")
    def resolve(file: pd.Series, dest: pd.Series) -> pd.Series:
        return pd.Series([posixpath.normpath(posixpath.join(posixpath.dirname(f or ""), d.split("#")[0])) for f, d in zip(file, dest, strict=True)])

    hits = parts.select("file_path", "heading_text", F.explode("links").alias("l")).select("file_path", "heading_text", "l.dest")
    hits = hits.where(F.lower(F.split_part("dest", F.lit("#"), F.lit(1))).rlike(r"\.mdx?$") & ~F.col("dest").rlike(r"^(?:[a-z][\w+.-]*:|/)"))
    return hits.select("file_path", "heading_text", resolve("file_path", "dest").alias("target")).distinct()
