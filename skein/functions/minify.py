"""Function bodies in fewer tokens (R20): comments, documentation and spare space removed, long locals shortened with a legend."""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from skein.sources import lexing

_LOCALS = {
    "python": r"(?m)^[ \t]+([a-z_]\w{5,})\s*(?::[^=\n]+)?=(?!=)|\bfor\s+([a-z_]\w{5,})\s+in\b",
    "rust": r"\blet\s+(?:mut\s+)?([a-z_]\w{5,})\b",
    "go": r"\b([a-z]\w{5,})\s*(?:,\s*\w+\s*)?:=",
    "javascript": r"\b(?:const|let|var)\s+([a-z_$][\w$]{5,})\b",
    "java": r"\b(?:var|int|long|double|boolean|String|[A-Z]\w*(?:<[^>]*>)?)\s+([a-z]\w{5,})\s*=",
}


def _short(taken: set[str]) -> str:
    for n in range(1, 10_000):
        name, k = "", n
        while k:
            k, r = divmod(k - 1, 26)
            name = chr(97 + r) + name
        if name not in taken and not keyword.iskeyword(name):
            return name
    raise ValueError("too many names")


def minify(body: str | None, file: str | None, language: str | None = None) -> tuple[str | None, dict[str, str]]:
    """(shorter body, legend of short name to name). Text in strings is kept; names that aren't plain locals are kept."""
    if not body:
        return body, {}
    kind = lexing.family(file, language)
    src = lexing.read(body, kind)
    out, last = [], 0
    for a, b, what in src.spans:
        lead = src.text[src.starts[src.line(a)] : a]
        if what == "c" or kind == "python" and not lead.strip() and src.text[a:b].lstrip("rRuU").startswith(('"""', "'''")):
            out += [src.text[last:a], ""]
            last = b
    text = "".join([*out, src.text[last:]])
    text = "\n".join(x.rstrip() for x in text.split("\n") if x.strip())
    src = lexing.read(text, kind)
    words = re.findall(r"[A-Za-z_$][\w$]*", src.text)
    taken, legend = set(words), {}
    signature = src.masked.split("\n", 1)[0]
    for m in re.finditer(_LOCALS.get(kind, r"(?!)"), src.masked):
        name = next(g for g in m.groups() if g)
        as_member = re.search(rf"[.$]{re.escape(name)}\b|\b{re.escape(name)}\s*[:=](?!=)[^=\n]*[,)]", src.masked)
        if name in legend.values() or re.search(rf"\b{re.escape(name)}\b", signature) or as_member or words.count(name) < 2:
            continue
        short = _short(taken)
        taken.add(short)
        legend[short] = name
    if legend:
        by = {v: k for k, v in legend.items()}
        parts, last = [], 0
        for a, b, what in src.spans:
            if what == "s":
                # interpolated strings may name locals: their texts stay, so the name has to stay as well
                for name in list(by):
                    if re.search(rf"\b{re.escape(name)}\b", src.text[a:b]):
                        legend.pop(by.pop(name))
        if by:
            rx = re.compile(r"(?<![\w$.])(?:" + "|".join(map(re.escape, by)) + r")(?![\w$])")
            for a, b, what in src.spans:
                if what == "s":
                    parts += [rx.sub(lambda m: by[m[0]], src.text[last:a]), src.text[a:b]]
                    last = b
            text = "".join([*parts, rx.sub(lambda m: by[m[0]], src.text[last:])])
    return text, legend


def minified(nodes: DataFrame) -> DataFrame:
    """id, body, legend of nodes (id, file, language, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [minify(b, f, lang) for b, f, lang in zip(batch["body"], batch["file"], batch["language"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "body": [x for x, _ in done], "legend": [y for _, y in done]})

    return nodes.select("id", "file", "language", "body").mapInPandas(run, "id string, body string, legend map<string,string>")
