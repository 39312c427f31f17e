"""Telling hand-written source files from generated, minified, vendored and data files.

Each file is lexed and its layout compared with a canonical re-emission of its
tokens, one statement or block edge to a line. Extreme expansion marks minified
text, dominance of literals data saved as code, and perfect uniformity (long
runs of statements of one shape) generated text. Claims in comments and the
conventions of paths and file names tell generated files that are laid out like
any other, and third-party copies. Files whose code equals that of a third-party file
up to comments and layout are copies as well.

Null and empty bodies are hand-written (nothing speaks against them). Repeated
nodes give repeated rows, folded by ``found``. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import bounded_join, spread, store
from skein.sources import lexing

#: Canonical lines to one line of code from which a text is minified, and the least length of code that counts.
EXPANSION, LEAST_CODE = 8.0, 200
#: Share of a file's code characters in literals from which it is data, and the least length of literals.
LITERALS, LEAST_LITERALS = 0.5, 200
#: Share of a file's code lines in one run of the same shape from which it is generated, and the least length of the run.
UNIFORM, LEAST_RUN = 0.8, 20

#: What comments of generated files say, in four languages.
GENERATED = re.compile(
    r"(?i)@generated\b|</?auto-?generated\b|\b(?:code|file|source|module|class|bindings?) (?:is |was |has been )?(?:auto-?|automatically |machine[- ])?generated\b|\bauto-?generated (?:file|code|source|from|by|with|on)\b"
    r"|\bautomatically (?:generated|produced|created|written|emitted)\b|\bautogenerated\b|\bgenerated (?:file|code|source|automatically|from|by|with|using)\b|\bmachine[- ](?:written|generated|made)\b"
    r"|\bdo(?:n't| not) (?:edit|modify|touch|change)\b|\bcode-?gen output\b|\boutput of [`'(]?\w+|\boverwritten on (?:every|each|the next)\b|\bmanual changes (?:will be|are) lost\b|\b(?:any )?(?:hand|manual) edits? (?:will be|are|is) (?:overwritten|lost)\b"
    r"|\bedits? (?:here )?ha(?:ve|s) no effect\b|\bedit \S+ and (?:re-?run|re-?generate|re-?build)\b|\bre-?generate (?:with|by|using)\b|\brebuilt by \w+|\bemitted bindings\b|\bcompiled (?:by|from) \w+.*\d|\bbuilt from the \w+ (?:grammar|schema|template|spec)"
    r"|\b(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)\b|\bnicht (?:bearbeiten|ändern|editieren)\b|\bgénéré(?:e)? (?:automatiquement|par)\b|\bne pas (?:modifier|éditer)\b|\bno (?:editar|modificar)\b|\bgenerado (?:automáticamente|por)\b"
)
#: What comments of third-party copies say.
VENDORED = re.compile(
    r"(?i)\bbundled copy\b|\bcopied (?:verbatim |unchanged )?from (?:the )?\S+ (?:distribution|project|release|repository|library|package|v?\d)|\bimported from \S+ v?\d|\bupstream (?:rev|commit|project|version|tag|copy)\b|\breport (?:problems|bugs|issues) upstream\b"
    r"|\bthird-party (?:file|code|copy|source)\b|\bvendored (?:from|copy)\b|\bkept in sync (?:by|with) (?:the )?(?:mirror|upstream)\b|\blocal (?:edits|changes) (?:are|will be) overwritten\b|\bmirror(?:ed)? (?:job|from|of)\b"
)
#: What comments say of files that are hand-written all the same.
DENIED = re.compile(r"(?i)\bnot (?:auto-?)?generated\b|\b(?:maintained|written|edited) by hand\b|\bmarked as do-not-edit\b|\bauto-?generated (?:method|constructor|catch|function|getter|setter|try|property|block|stub)|\bplease edit freely\b|\bhand-?written\b|\bthis (?:module|file|script|class|package|tool) (?:generates|emits|writes|produces|copies|imports)\b")
#: Conventions of directories and file names.
GENERATED_PATH = re.compile(r"(?i)(?:^|/)(?:_*generated_*|gen|generated[-_]sources|__generated__|\.generated|autogen)/|(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.pb\.gw\.go|Grpc\.java|OuterClass\.java|\.generated\.\w+|\.g\.\w+|\.designer\.cs|_generated\.\w+)$|(?:^|/)zz_generated[._]")
VENDORED_PATH = re.compile(r"(?i)(?:^|/)(?:_?vendor|node_modules|bower_components|third[-_]?party|3rd[-_]?party|site-packages|dist-packages|Godeps|Pods|jspm_packages|\.cargo/registry)/|(?:^|/)externals?/(?:[^/]+/)+[^/]*$|(?:^|/)(?:deps|libs)/[^/]+/|(?:^|/)(?:deps|libs)/[^/]*\d+\.\d+[^/]*$")
MINIFIED_PATH = re.compile(r"(?i)(?:[.-]min|\.bundle|\.packed)\.(?:m?js|css|ts)$")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»")
#: Least characters of code for which an equal third-party file makes a copy.
LEAST_COPY = 200
_SPACES = re.compile(r"\s+")
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\w*")
_EDGE = re.compile(r"[;{}]")


def canonical_lines(code: str, kind: str) -> int:
    """How many lines the canonical layout has: one for each statement and block edge."""
    if kind in ("python", "hash"):
        return code.count("\n") + 1 + code.count(";")
    heads = sum(1 for m in re.finditer(r"\bfor\s*\([^()]*;[^()]*;", code))
    return len(_EDGE.findall(code)) - 2 * heads


def layout(src: lexing.Source) -> dict:
    """What the lexer tells of a file: code and literal lengths, expansion and uniformity."""
    masked = src.masked
    bare = len(_SPACES.sub("", masked))
    text_in_strings = sum(b - a for a, b, k in src.spans if k == "s" and not (src.kind == "python" and _opens_statement(src, a)))
    numbers = sum(len(m) for m in _NUMBER.findall(masked))
    literals = text_in_strings + numbers
    lines = [x for x in masked.split("\n") if x.strip()]
    shapes = [re.sub(r"\d+|[A-Za-z_]+|\s+", "", x)[:60] + str(x.count(",")) for x in lines]
    run = best = 0
    previous = None
    for s in shapes:
        run = run + 1 if s == previous else 1
        previous, best = s, max(best, run)
    return {"code": bare, "literals": literals, "share": literals / max(1, bare + text_in_strings), "lines": len(lines), "expansion": canonical_lines(masked, src.kind) / max(1, len(lines)), "run": best, "uniform": best / max(1, len(shapes)), "longest": max(map(len, lines), default=0)}


def _opens_statement(src: lexing.Source, at: int) -> bool:
    """Whether a Python string stands alone as a statement (a docstring)."""
    line = src.starts[src.line(at)]
    return not src.masked[line:at].strip()


def claims(src: lexing.Source) -> set[str]:
    """What the file's comments claim about its origin: generated, vendored. Quoted text claims nothing."""
    out = set()
    for a, b, kind in src.spans:
        if kind != "c":
            continue
        for line in src.text[a:b].split("\n"):
            said = _QUOTED.sub(" ", line)
            if DENIED.search(said):
                continue
            if VENDORED.search(said):
                out.add("vendored")
            elif GENERATED.search(said):
                out.add("generated")
    return out


def origin(text: str | None, file: str | None, language: str | None) -> tuple[str, str, str | None]:
    """(class, reason, fingerprint of the code): hand_written, generated, minified, vendored or data."""
    path = (file or "").replace("\\", "/")
    if not text or not text.strip():
        return "hand_written", "empty", None
    src = lexing.read(text, lexing.family(file, language))
    code = _SPACES.sub("", "".join(src.text[a:b] for a, b in _outside_comments(src)))
    said, seen = claims(src), layout(src)
    if VENDORED_PATH.search(path):
        return "vendored", "path", code
    if "vendored" in said:
        return "vendored", "claim", code
    if seen["expansion"] >= EXPANSION and seen["code"] >= LEAST_CODE:
        return "minified", "layout", code
    if seen["share"] >= LITERALS and seen["literals"] >= LEAST_LITERALS:
        return "data", "literals", code
    if MINIFIED_PATH.search(path):
        return "minified", "name", code
    if "generated" in said:
        return "generated", "claim", code
    if GENERATED_PATH.search(path):
        return "generated", "path", code
    if seen["uniform"] >= UNIFORM and seen["run"] >= LEAST_RUN:
        return "generated", "uniform", code
    return "hand_written", "", code


def _outside_comments(src: lexing.Source):
    last = 0
    for a, b, kind in src.spans:
        if kind == "c":
            yield last, a
            last = b
    yield last, len(src.text)


CLASSES = "root string, file string, origin string, reason string, fingerprint string"


def classify(nodes: DataFrame) -> DataFrame:
    """root, file, origin, reason, fingerprint of each module node, from its own text and path."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for root, file, language, body in zip(batch["root"], batch["file"], batch["language"], batch["body"], strict=True):
                kind, reason, code = origin(body, file, language)
                mark = hashlib.sha256(code.encode("utf-8", "surrogatepass")).hexdigest()[:32] if code and len(code) >= LEAST_COPY else None
                rows.append((root, file, kind, reason, mark))
            yield pd.DataFrame(rows, columns=["root", "file", "origin", "reason", "fingerprint"])

    return spread(nodes.where("kind = 'module'").select("root", "file", "language", "body")).mapInPandas(read, CLASSES)


def origins(nodes: DataFrame) -> DataFrame:
    """root, file, origin, reason: ``classify``, with files that equal a third-party file as vendored too."""
    own = store(classify(nodes), "origins")
    third = store(own.df.where("origin = 'vendored' and fingerprint is not null").select("fingerprint").distinct().withColumn("copied", F.lit(True)), "third_party")
    both = bounded_join(own.df, third, ["fingerprint"], "left", spread=["root", "file"])
    copied = (F.col("origin") == "hand_written") & F.coalesce("copied", F.lit(False))
    return both.select("root", "file", F.when(copied, "vendored").otherwise(F.col("origin")).alias("origin"), F.when(copied, "copy").otherwise(F.col("reason")).alias("reason"))


def found(nodes: DataFrame) -> DataFrame:
    """root, file: the files that are not hand-written."""
    return origins(nodes).where("origin <> 'hand_written'").select("root", "file").distinct()


def hand_written(nodes: DataFrame) -> DataFrame:
    """root, file: the hand-written files."""
    by_file = origins(nodes).groupBy("root", "file").agg(F.bool_and(F.col("origin") == "hand_written").alias("own"))
    return by_file.where("own").select("root", "file")
