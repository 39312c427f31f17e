"""Functions paired with their documentation.

Comment spans and function spans of a file are extracted independently. The
comment blocks, ordered by their last line, are matched to the functions as of
the line above each definition; a match is rejected when anything but
decorators, annotations or attributes stands between the two.

Nodes whose body is null or empty have no functions. Repeated nodes give
repeated pairs, which ``found`` folds into one. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.llm.triviality import is_trivial
from skein.session import spread
from skein.sources import lexing

_TAIL = {"python": re.compile(r"\s*(?:->\s*[^:\n]+)?"), "": re.compile(r"[^{;\n=]*")}
_STRING = re.compile(r"(?i)^([rbuft]{0,2})('''|\"\"\"|'|\")")


def comment_blocks(src: lexing.Source) -> list[tuple[int, int, str]]:
    """(first line, last line, text): maximal runs of lines that hold comments only. Lines are 0-based.

    A comment that shares a line with code starts or ends no block. Shebang
    lines are no comments.
    """
    lines: dict[int, bool] = {}
    for a, b, kind in src.spans:
        if kind != "c" or (a == 0 and src.text.startswith("#!")):
            continue
        for k in range(src.line(a), src.line(max(b - 1, a)) + 1):
            end = src.starts[k + 1] if k + 1 < len(src.starts) else len(src.masked)
            lines[k] = not src.masked[src.starts[k] : end].strip()
    out, run = [], []
    for k in sorted(k for k, alone in lines.items() if alone):
        if run and k != run[-1] + 1:
            out.append(run)
            run = []
        run.append(k)
    if run:
        out.append(run)

    def text(run):
        end = src.starts[run[-1] + 1] if run[-1] + 1 < len(src.starts) else len(src.text)
        return src.text[src.starts[run[0]] : end]

    return [(r[0], r[-1], text(r)) for r in out]


def docstring(src: lexing.Source, fn: lexing.Function, strings: list[tuple[int, int]]) -> str | None:
    """The string that opens a Python function's body."""
    masked = src.masked
    colon, depth = fn.head_end, 0
    while colon < len(masked) and not (masked[colon] == ":" and depth == 0):
        depth += (masked[colon] in "([{") - (masked[colon] in ")]}")
        colon += 1
    k = bisect_right(strings, (colon, 0))
    if k >= len(strings):
        return None
    a, b = strings[k]
    line_end = masked.find("\n", b)
    if masked[colon + 1 : a].strip() or masked[b : line_end if line_end >= 0 else len(masked)].strip(" \t;"):
        return None
    m = _STRING.match(src.text[a:b])
    if not m or set(m[1].lower()) & {"b", "f", "t"}:
        return None
    return src.text[a + m.end() : b - len(m[2])]


def pairs(text: str, file: str | None, language: str | None) -> list[dict]:
    """Every function of a source text that has documentation, trivial or not."""
    src = lexing.read(text, lexing.family(file, language))
    found = lexing.functions(src)
    if not found:
        return []
    blocks = comment_blocks(src)
    lasts = [b[1] for b in blocks]
    decorators = lexing.decorator_lines(src)
    strings = [(a, b) for a, b, k in src.spans if k == "s"] if src.kind == "python" else []
    out = []
    for fn in found:
        line = src.line(fn.at)
        before = src.masked[src.starts[line] : fn.at]
        doc = None
        # only the first definition of a line can be what the line above documents
        k = bisect_right(lasts, line - 1) - 1 if not re.search("[;{}]", before) else -1
        if k >= 0 and all(x in decorators for x in range(lasts[k] + 1, line)):
            doc = blocks[k][2]
        elif strings:
            doc = docstring(src, fn, strings)
        if doc is None:
            continue
        signature = re.sub(r"\s+", " ", src.text[src.starts[line] : fn.head_end]).strip()
        tail = _TAIL["python" if src.kind == "python" else ""].match(src.text, fn.head_end)[0].rstrip()
        out.append({"name": fn.name, "line_start": line + 1, "line_end": src.line(max(fn.end - 1, fn.at)) + 1, "signature": signature + tail, "body": src.text[src.starts[line] : fn.end], "doc": doc, "trivial": is_trivial(doc, fn.name, signature + tail)})
    return out



PAIRS = "root string, file string, name string, line_start int, line_end int, signature string, body string, doc string, trivial boolean"


def _sources(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'module' and body <> ''").select("root", "file", "language", "body")


def function_docs(nodes: DataFrame, bodies: bool = True) -> DataFrame:
    """One row for each documented function of each module node; ``trivial`` marks documentation that says nothing."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PAIRS.split(", ")]
        for batch in batches:
            rows = []
            for root, file, language, body in zip(batch["root"], batch["file"], batch["language"], batch["body"], strict=True):
                for p in pairs(body, file, language):
                    rows.append((root, file, p["name"], p["line_start"], p["line_end"], p["signature"], p["body"] if bodies else None, p["doc"] if bodies else None, p["trivial"]))
            yield pd.DataFrame(rows, columns=names)

    return spread(_sources(nodes)).mapInPandas(extract, PAIRS)


def found(nodes: DataFrame) -> DataFrame:
    """root, file, name, line_start: the functions whose documentation isn't trivial."""
    return function_docs(nodes, bodies=False).where("not trivial").select("root", "file", "name", "line_start").distinct()


def code_description_pairs(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """The pairs with cleaned descriptions and what the newest symbol record says.

    ``doc_status`` compares ``symbols.doc_comment`` with the file: same, stale
    (differs), missing (no symbol or no comment there).
    """
    docs = function_docs(nodes).where("not trivial").drop("trivial")
    order = W.partitionBy("root", "file", "name", "line_start").orderBy(F.length("doc").desc(), "doc", "body")
    docs = docs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    flat = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?m)^[ \t]*(/\*+!?|\*+/|\*|//[/!]*|#+!?)|\*+/[ \t]*$", " "), r"\s+", " "))
    newest = (
        symbols.where("kind = 'function' and doc_comment is not null")
        .groupBy(F.col("root_id").alias("root"), F.col("file_path").alias("file"), "name")
        .agg(F.max_by("doc_comment", F.struct("scan_version", "updated_at", "doc_comment")).alias("symbol_doc"))
    )
    out = docs.withColumn("description", flat(F.col("doc"))).drop("doc").join(newest, ["root", "file", "name"], "left")
    same = F.when(F.col("symbol_doc").isNull() | (F.trim("symbol_doc") == ""), "missing").when(flat(F.col("symbol_doc")) == F.col("description"), "same").otherwise("stale")
    return out.withColumn("doc_status", same).drop("symbol_doc")
