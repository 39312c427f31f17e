"""Extractors: source files to nodes and edges.

A registry maps extensions to parsers, and one ``mapInPandas`` runs them over
files; an error in a file becomes a row. Python is parsed by the standard
library's grammar; SQL DDL, Protobuf, GraphQL, JSON, TOML, YAML, OpenAPI,
Dockerfiles, HTML, HCL and Markdown by line-based parsers; Rust, TypeScript,
JavaScript, Go, Java, Kotlin, C#, C, C++, Swift, Scala, PHP, Dart, Ruby, Lua, Bash,
Zig and Elixir by the lexer of this package with rules by language. The second
group is less than a grammar: see the README for what each covers.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from skein import schema
from skein.session import spread
from skein.sources import lexing
from skein.sources.markdown import chunks

#: Extension to language of a file.
LANGUAGES = {
    "py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin",
    "cs": "csharp", "c": "c", "h": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "swift": "swift", "scala": "scala", "sc": "scala", "php": "php", "dart": "dart", "rb": "ruby", "lua": "lua",
    "sh": "bash", "bash": "bash", "zig": "zig", "ex": "elixir", "exs": "elixir", "sql": "sql", "proto": "proto", "graphql": "graphql", "gql": "graphql", "json": "json", "jsonc": "json", "toml": "toml", "yaml": "yaml",
    "yml": "yaml", "html": "html", "htm": "html", "tf": "hcl", "hcl": "hcl", "tfvars": "hcl", "md": "markdown", "mdx": "markdown",
}
ROWS = "what string, root string, file string, name string, kind string, language string, line_start int, line_end int, signature string, body string, metadata map<string,string>, target string, edge_type string"


class Out:
    """Nodes and edges of one file."""

    def __init__(self, root: str, file: str, language: str):
        self.root, self.file, self.language, self.rows = root, file, language, []

    def id(self, name: str, kind: str) -> str:
        return f"{self.root}:{self.file}:{name}:{kind}"

    def node(self, name: str, kind: str, line: int, end: int | None = None, signature: str = "", body: str = "", **meta) -> str:
        meta = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in meta.items() if v not in (None, "")}
        self.rows.append(("node", self.root, self.file, name, kind, self.language, line, end or line, signature, body, meta, None, None))
        return self.id(name, kind)

    def edge(self, source: str, target: str, kind: str) -> None:
        self.rows.append(("edge", self.root, self.file, source, None, self.language, None, None, None, None, {}, target, kind))

    def module(self, text: str) -> str:
        stem = self.file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        return self.node(stem, "module", 1, text.count("\n") + 1)


def _pattern_hint(name: str) -> str | None:
    return next((s.lower() for s in schema.PATTERN_SUFFIXES if name.endswith(s) and name != s), None)


def _literals(out: Out, src: lexing.Source) -> None:
    """String literals of more than 3 characters, once for each value at its first line."""
    seen = set()
    for a, b, kind in src.spans:
        if kind == "s" and (m := re.match(r"""(?is)^[a-z]{0,2}[#]*('''|\"\"\"|'|"|`)(.*)\1[#]*$""", src.text[a:b])):
            value = m[2]
            if len(value) > 3 and "\n" not in value and value not in seen:
                seen.add(value)
                out.node(value, "const", src.line(a) + 1, synthetic=True)


# Python ------------------------------------------------------------------------


def _branches(node: ast.AST) -> int:
    """Branches and logical operators, without nested functions."""
    n = 0
    stack = list(ast.iter_child_nodes(node))
    while stack:
        x = stack.pop()
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            continue
        if isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case, ast.comprehension)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        stack.extend(ast.iter_child_nodes(x))
    return n


_PRIMITIVES = {"int", "str", "float", "bool", "bytes", "None", "object", "Any", "list", "dict", "set", "tuple", "self", "cls", "Optional", "Union", "List", "Dict", "Set", "Tuple"}


def python(out: Out, text: str) -> None:
    tree = ast.parse(text)
    lines = text.splitlines()
    module = out.module(text)
    public = {e.value for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)) for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}

    def visit(body, owner, owner_name, in_class):
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                names = [ast.unparse(d) for d in n.decorator_list]
                sig = ("async def " if isinstance(n, ast.AsyncFunctionDef) else "def ") + f"{n.name}({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
                test = n.name.startswith("test_") or any("pytest" in d for d in names)
                fid = out.node(n.name, "function", n.lineno, n.end_lineno, sig, "\n".join(lines[n.lineno - 1 : n.end_lineno]), cyclomatic=1 + _branches(n), decorators=", ".join(names), is_async=isinstance(n, ast.AsyncFunctionDef) or None, is_static="staticmethod" in names or None, is_test=test or None, doc_comment=ast.get_docstring(n), parent_scope=owner_name, exported=n.name in public or None)
                out.edge(owner, fid, "defines")
                kinds = [a.annotation for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs] if a.annotation] + ([n.returns] if n.returns else [])
                for t in sorted({x.id for k in kinds for x in ast.walk(k) if isinstance(x, ast.Name)} - _PRIMITIVES):
                    out.edge(fid, out.id(t, "struct"), "depends_on")
                for d in n.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str) and d.func.attr in ("get", "post", "put", "delete", "patch", "route", "head", "options"):
                        method = "GET" if d.func.attr == "route" else d.func.attr.upper()
                        ep = out.node(f"{method} {d.args[0].value}", "api_endpoint", d.lineno, http_method=method, http_path=d.args[0].value, router_var=ast.unparse(d.func.value))
                        out.edge(fid, ep, "implements")
                visit(n.body, fid, n.name, False)
            elif isinstance(n, ast.ClassDef):
                cid = out.node(n.name, "struct", n.lineno, n.end_lineno, f"class {n.name}" + (f"({', '.join(map(ast.unparse, n.bases))})" if n.bases else ""), decorators=", ".join(ast.unparse(d) for d in n.decorator_list), doc_comment=ast.get_docstring(n), pattern_hint=_pattern_hint(n.name))
                out.edge(owner, cid, "defines")
                for b in n.bases:
                    out.edge(cid, out.id(ast.unparse(b), "trait"), "implements")
                for f in n.body:
                    if isinstance(f, ast.AnnAssign) and isinstance(f.target, ast.Name):
                        out.edge(cid, out.node(f.target.id, "field", f.lineno, signature=ast.unparse(f), parent_scope=n.name), "has_field")
                visit(n.body, cid, n.name, True)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                stated = ast.unparse(n)
                iid = out.node(stated, "import", n.lineno, n.end_lineno, stated)
                target = ("." * n.level + (n.module or "")) if isinstance(n, ast.ImportFrom) else n.names[0].name
                out.edge(iid, out.id(target, "module"), "depends_on")
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and not in_class:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", t.id):
                        out.edge(owner, out.node(t.id, "const", n.lineno, n.end_lineno, ast.unparse(n)), "defines")
            elif isinstance(n, (ast.If, ast.Try, ast.With)):
                visit([*n.body, *getattr(n, "orelse", []), *getattr(n, "finalbody", [])], owner, owner_name, in_class)

    visit(tree.body, module, None, False)
    _literals(out, lexing.read(text, "python"))


# Languages of the lexer ----------------------------------------------------------

_TYPES = {
    "rust": r"\b(?:pub(?:\([^)]*\))?\s+)?(struct|enum|trait|type|mod|macro_rules!)\s+(\w+)",
    "go": r"^type\s+(\w+)\s+(struct|interface)?",
    "java": r"\b(class|interface|enum|record|object|struct|protocol|trait|@interface)\s+(\w+)",
    "javascript": r"\b(class|interface|enum|type(?=\s+\w+\s*[=<]))\s+(\w+)",
    "c": r"\b(struct|enum|class|union|namespace)\s+(\w+)\s*[{:]",
    "hash": r"^[ \t]*(class|module|defmodule)\s+([\w.:]+)",
    "python": r"^[ \t]*(class)\s+(\w+)",
}
_KINDS = {"struct": "struct", "class": "struct", "record": "struct", "object": "struct", "union": "struct", "enum": "enum", "trait": "trait", "interface": "trait", "protocol": "trait", "@interface": "trait", "type": "type_alias", "mod": "module", "module": "module", "namespace": "module", "defmodule": "module", "macro_rules!": "macro"}
_IMPORTS = {
    "rust": r"(?m)^[ \t]*((?:pub(?:\([^)]*\))?\s+)?use\s+[^;]+;)",
    "go": r"(?m)^import\s+(\"[^\"]+\"|\w+\s+\"[^\"]+\")|^import\s*\(([^)]*)\)",
    "java": r"(?m)^[ \t]*((?:import|using)\s+[^;\n{]+;?)",
    "javascript": r"(?m)^[ \t]*(import\b[^;\n]*(?:\{[^}]*\}[^;\n]*)?;?|(?:const|let|var)\s+[^=\n]+=\s*require\([^)]*\);?)",
    "c": r"(?m)^[ \t]*(#include\s*[<\"][^>\"]+[>\"])",
    "python": r"(?m)^[ \t]*((?:from\s+\S+\s+)?import\s+[^\n]+)",
    "hash": r"(?m)^[ \t]*((?:require|require_relative|source|import|alias|use)\s+[^\n]+)",
}
_CONSTS = {
    "rust": r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static(?:\s+mut)?)\s+(\w+)\s*:",
    "go": r"(?m)^(?:const|var)\s+(\w+)",
    "java": r"\b(?:static\s+final|const(?:\s+val)?|final\s+static)\s+(?:[\w<>\[\]]+\s+)?(\w+)\s*=",
    "javascript": r"(?m)^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=(?!\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>)",
    "c": r"(?m)^[ \t]*#define\s+(\w+)|\b(?:constexpr|static\s+const)\s+[\w:<>]+\s+(\w+)\s*=",
    "python": r"(?m)^([A-Z][A-Z0-9_]*)\s*(?::[^=\n]+)?=",
    "hash": r"(?m)^[ \t]*(?:readonly\s+|export\s+)?([A-Z][A-Z0-9_]+)=",
}
_EXTRA_DEFS = {"swift": r"\bfunc\s+(\w+)", "scala": r"\bdef\s+(\w+)", "kotlin": r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)", "php": r"\bfunction\s+(\w+)", "lua": r"\bfunction\s+([\w.:]+)", "zig": r"\bfn\s+(\w+)", "bash": r"(?m)^[ \t]*(?:function\s+)?([\w-]+)\s*\(\)\s*\{", "elixir": r"(?m)^[ \t]*defp?\s+(\w+[?!]?)|^[ \t]*defmacrop?\s+(\w+)", "ruby": r"(?m)^[ \t]*def\s+(?:self\.)?(\w+[?!=]?)"}
_BRANCH = re.compile(r"\b(?:if|elif|else if|for|while|case|catch|match|when|except|unless|guard|loop|and|or)\b|&&|\|\||\?(?=[^?.:])")


def _lexed(out: Out, text: str) -> None:
    family = lexing.family(out.file, out.language)
    src = lexing.read(text, family)
    module = out.module(text)
    defined: list[tuple[int, int, str, str]] = []
    for m in re.finditer(_TYPES[family], src.masked, re.M):
        word, name = (m[2] or "type", m[1]) if family == "go" else (m[1], m[2])
        kind = _KINDS.get(word, "struct")
        brace = src.masked.find("{", m.end())
        end = lexing.close(src.masked, brace) if 0 <= brace - m.end() < 400 else m.end()
        line = src.line(m.start()) + 1
        sig = src.text[m.start() : brace if 0 <= brace - m.end() < 400 else m.end()].strip()
        tid = out.node(name, kind, line, src.line(max(end - 1, m.start())) + 1, sig, pattern_hint=_pattern_hint(name), exported=bool(re.match(r"\s*(?:pub|export)\b", src.text[src.starts[line - 1] : m.end()])) or None)
        out.edge(module, tid, "defines")
        defined.append((m.start(), end, name, tid))
        for base in re.findall(r"(?:extends|implements|:)\s+([A-Z]\w*)", sig):
            out.edge(tid, out.id(base, "trait"), "implements")
    if family == "rust":
        for m in re.finditer(r"\bimpl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)", src.masked):
            out.edge(out.id(m[2], "struct"), out.id(m[1].rsplit("::", 1)[-1], "trait"), "implements")
        for m in re.finditer(r"\bimpl(?:<[^>]*>)?\s+(?:[\w:]+(?:<[^>]*>)?\s+for\s+)?(\w+)[^{;]*\{", src.masked):
            defined.append((m.start(), lexing.close(src.masked, m.end() - 1), m[1], out.id(m[1], "struct")))
    decorators = lexing.decorator_lines(src)
    found = [(f.name, f.at, f.end, f.head_end) for f in lexing.functions(src)]
    if extra := _EXTRA_DEFS.get(out.language):
        known = {at for _, at, _, _ in found}
        for m in re.finditer(extra, src.masked, re.M):
            g = next(k for k in range(1, m.re.groups + 1) if m[k])
            if m.start(g) not in known:
                brace = src.masked.find("{", m.end())
                end = lexing.close(src.masked, brace) if 0 <= brace - m.end() < 300 else m.end()
                found.append((m[g], m.start(g), end if end > 0 else len(text), m.end()))
    for name, at, end, head in sorted(found, key=lambda f: f[1]):
        line = src.line(at)
        above, k = [], line - 1
        while k in decorators:
            above.append(src.text[src.starts[k] : src.starts[k + 1]].strip())
            k -= 1
        doc = []
        while k >= 0 and src.text[src.starts[k] : src.starts[k + 1]].strip() and not src.masked[src.starts[k] : src.starts[k + 1]].strip():
            doc.append(re.sub(r"^\s*(?:/\*+!?|\*+/|\*|//[/!]*|#+)\s?|\s*\*+/\s*$", "", src.text[src.starts[k] : src.starts[k + 1]]).strip())
            k -= 1
        body = src.text[src.starts[line] : end]
        lead = src.text[src.starts[line] : at]
        test = any(re.search(r"\btest\b|@Test\b|\[Test\]|\[Fact\]", d) for d in above) or (out.language == "go" and name.startswith("Test"))
        inside = [d for d in defined if d[0] < at < d[1]]
        owner = max(inside, default=None, key=lambda d: d[0])
        fid = out.node(name, "function", line + 1, src.line(max(end - 1, at)) + 1, re.sub(r"\s+", " ", src.text[src.starts[line] : head]).strip(), body, cyclomatic=1 + len(_BRANCH.findall(src.masked[head:end])), decorators=", ".join(reversed(above)), is_async=bool(re.search(r"\basync\b", lead)) or None, is_static=bool(re.search(r"\bstatic\b", lead)) or None, is_test=test or None, exported=bool(re.match(r"\s*(?:pub|export|public)\b", lead)) or None, parent_scope=owner[2] if owner else None, doc_comment="\n".join(x for x in reversed(doc) if x))
        out.edge(owner[3] if owner else module, fid, "defines")
    for m in re.finditer(_IMPORTS[family], lexing_comments_blank(src)):
        for part in (g for g in m.groups() if g):
            for line in part.splitlines() if family == "go" else [part]:
                if line.strip():
                    iid = out.node(line.strip(), "import", src.line(m.start(0)) + 1)
                    target = re.search(r"[\"'<]([^\"'>]+)[\"'>]", line) or re.search(r"(?:use|import|using)\s+(?:static\s+)?([\w.]+)", line)
                    if target:
                        out.edge(iid, out.id(target[1], "module"), "depends_on")
    for m in re.finditer(_CONSTS[family], src.masked):
        name = next(g for g in m.groups() if g)
        out.edge(module, out.node(name, "const", src.line(m.start()) + 1, signature=src.text[m.start() : src.text.find("\n", m.end()) if src.text.find("\n", m.end()) > 0 else len(text)].strip()), "defines")
    if family in ("rust", "javascript"):
        for m in re.finditer(r"(?m)^\s*pub\s+use\s+[^;]*?(?:\{([^}]*)\}|::(\w+))\s*;|^export\s*(?:type\s*)?\{([^}]*)\}", src.masked):
            for name in re.findall(r"([A-Za-z_]\w*)(?:\s+as\s+\w+)?", m[1] or m[2] or m[3] or ""):
                out.edge(module, out.id(name, "function" if name[0].islower() else "struct"), "re_exports")
    if family == "javascript":
        for m in re.finditer(r"\b(\w+)\.(get|post|put|delete|patch)\(\s*[\"'`](/[^\"'`]*)[\"'`]", lexing_comments_blank(src)):
            out.node(f"{m[2].upper()} {m[3]}", "api_endpoint", src.line(m.start()) + 1, http_method=m[2].upper(), http_path=m[3], router_var=m[1])
    _literals(out, src)


def lexing_comments_blank(src: lexing.Source) -> str:
    """The text with its comments blanked and its strings kept."""
    out, last = [], 0
    for a, b, kind in src.spans:
        if kind == "c":
            out += [src.text[last:a], re.sub(r"[^\n]", " ", src.text[a:b])]
            last = b
    return "".join([*out, src.text[last:]])


# Schemas and data ------------------------------------------------------------------


def sql(out: Out, text: str) -> None:
    plain = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    line = lambda at: plain.count("\n", 0, at) + 1
    ident = r"[\"`\[]?([\w.]+)[\"`\]]?"
    for m in re.finditer(rf"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?{ident}\s*\(", plain):
        end = lexing.close(plain, m.end() - 1)
        tid = out.node(m[1], "sql_table", line(m.start()), line(end), plain[m.start() : m.end() - 1].strip(), plain[m.start() : end])
        depth, part, at = 0, "", m.end()
        for k in range(m.end(), end):
            ch = plain[k]
            depth += (ch == "(") - (ch == ")")
            if depth < 0 or (ch == "," and depth == 0):
                _column(out, m[1], tid, part.strip(), line(at))
                part, at = "", k + 1
            else:
                part += ch
    for m in re.finditer(rf"(?i)\balter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{ident}\s+([^;]+)", plain):
        aid = out.node(re.sub(r"\s+", " ", m[0]), "sql_alter", line(m.start()), signature=re.sub(r"\s+", " ", m[0]))
        out.edge(aid, out.id(m[1], "sql_table"), "evolves")
    for m in re.finditer(rf"(?i)\bcreate\s+type\s+{ident}\s+as\s+enum\s*\(([^)]*)\)", plain):
        eid = out.node(m[1], "enum", line(m.start()))
        for v in re.findall(r"'([^']*)'", m[2]):
            out.edge(eid, out.node(v, "enum_variant", line(m.start())), "has_field")


def _column(out: Out, table: str, tid: str, text: str, line: int) -> None:
    if not text:
        return
    for ref in re.findall(r"(?i)\breferences\s+[\"`\[]?([\w.]+)", text):
        out.edge(tid, out.id(ref, "sql_table"), "depends_on")
    if re.match(r"(?i)(primary|foreign|unique|check|constraint|index|key|exclude)\b", text):
        return
    m = re.match(r"[\"`\[]?(\w+)[\"`\]]?\s+([\w ]+(?:\([^)]*\))?)", text)
    if m:
        out.edge(tid, out.node(f"{table}.{m[1]}", "sql_column", line, signature=re.sub(r"\s+", " ", text)), "has_field")


def proto(out: Out, text: str) -> None:
    src = lexing.read(text, "java")
    for m in re.finditer(r"\b(message|enum|service)\s+(\w+)\s*\{", src.masked):
        end = lexing.close(src.masked, m.end() - 1)
        kind = {"message": "proto_message", "enum": "enum", "service": "proto_service"}[m[1]]
        pid = out.node(m[2], kind, src.line(m.start()) + 1, src.line(max(end - 1, 0)) + 1, f"{m[1]} {m[2]}")
        inner = src.masked[m.end() : end]
        if kind == "proto_message":
            flat = re.sub(r"\b(?:message|enum)\s+\w+\s*\{[^{}]*\}", lambda x: " " * len(x[0]), inner)
            for f in re.finditer(r"(?:repeated|optional|required)?\s*([\w.]+(?:<[^>]*>)?)\s+(\w+)\s*=\s*\d+", flat):
                out.edge(pid, out.node(f"{m[2]}.{f[2]}", "proto_field", src.line(m.end() + f.start()) + 1, signature=f[0].strip()), "has_field")
        elif kind == "proto_service":
            for r in re.finditer(r"\brpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)", inner):
                rid = out.node(r[1], "function", src.line(m.end() + r.start()) + 1, signature=r[0], parent_service=m[2], rpc_request_type=r[2], rpc_response_type=r[3])
                out.edge(pid, rid, "defines")
                for t in (r[2], r[3]):
                    out.edge(rid, out.id(t, "proto_message"), "depends_on")


def graphql(out: Out, text: str) -> None:
    src = lexing.read(text, "hash")
    for m in re.finditer(r"\b(type|input|interface|enum|fragment|query|mutation|subscription)\s+(\w+)([^{]*)\{", src.masked):
        end = lexing.close(src.masked, m.end() - 1)
        kind = {"fragment": "graphql_fragment", "enum": "enum", "interface": "trait", "query": "function", "mutation": "function", "subscription": "function"}.get(m[1], "graphql_type")
        gid = out.node(m[2], kind, src.line(m.start()) + 1, src.line(max(end - 1, 0)) + 1, f"{m[1]} {m[2]}")
        for i in re.findall(r"implements\s+([\w& ]+)", m[3]):
            for name in re.findall(r"\w+", i):
                out.edge(gid, out.id(name, "trait"), "implements")
        inner = src.masked[m.end() : end]
        if m[1] in ("type", "input", "interface"):
            for f in re.finditer(r"(?m)^\s*(\w+)\s*(?:\([^)]*\))?\s*:\s*([\[\]\w!]+)", inner):
                out.edge(gid, out.node(f"{m[2]}.{f[1]}", "field", src.line(m.end() + f.start(1)) + 1, signature=f[0].strip()), "has_field")
                base = re.sub(r"[\[\]!]", "", f[2])
                if base not in ("Int", "Float", "String", "Boolean", "ID"):
                    out.edge(gid, out.id(base, "graphql_type"), "depends_on")
        elif m[1] == "enum":
            for v in re.findall(r"\b\w+\b", inner):
                out.edge(gid, out.node(f"{m[2]}.{v}", "enum_variant", src.line(m.start()) + 1), "has_field")


def dockerfile(out: Out, text: str) -> None:
    stages: dict[str, str] = {}
    for k, line in enumerate(text.splitlines(), 1):
        if m := re.match(r"(?i)\s*FROM\s+(?:--\S+\s+)?(\S+)(?:\s+AS\s+(\S+))?", line):
            fid = out.node(m[2] or m[1], "dockerfile_from", k, signature=line.strip(), image=m[1])
            if m[1] in stages:
                out.edge(fid, stages[m[1]], "depends_on")
            if m[2]:
                stages[m[2]] = fid
        elif m := re.match(r"(?i)\s*EXPOSE\s+(.*)", line):
            for port in m[1].split():
                out.node(port, "dockerfile_port", k)
        elif (m := re.search(r"(?i)^\s*COPY\s+.*--from=(\S+)", line)) and m[1] in stages and out.rows:
            last = [r for r in out.rows if r[0] == "node" and r[4] == "dockerfile_from"][-1]
            out.edge(out.id(last[3], "dockerfile_from"), stages[m[1]], "depends_on")


def _yaml_keys(text: str) -> list[tuple[str, int, str]]:
    """(key, line, value) at the top level of a YAML text."""
    return [(m[1].strip("\"'"), k, (m[2] or "").strip()) for k, line in enumerate(text.splitlines(), 1) if (m := re.match(r"([\w./$\"'-][^:#]*?)\s*:(?:\s+(.*))?$", line))]


def yaml(out: Out, text: str) -> None:
    if re.search(r"(?m)^(?:openapi|swagger)\s*:", text):
        openapi_yaml(out, text)
        return
    line = 0
    for doc in re.split(r"(?m)^---[ \t]*$", text):
        keys = _yaml_keys(doc)
        by = {k: v for k, _, v in keys}
        if by.get("kind") and "apiVersion" in by:
            name = re.search(r"(?m)^metadata:\s*\n(?:[ \t]+.*\n)*?[ \t]+name:\s*(\S+)", doc + "\n")
            out.node(f"{by['kind']}/{name[1] if name else ''}", "yaml_key", line + 1, resource=by["kind"])
        for key, k, _ in keys:
            out.node(key, "yaml_key", line + k)
        line += doc.count("\n")


def toml(out: Out, text: str) -> None:
    tomllib.loads(text)
    for k, line in enumerate(text.splitlines(), 1):
        if (m := re.match(r"\s*\[+([^\]]+)\]+", line)) or (m := re.match(r"([\w.-]+)\s*=", line)):
            out.node(m[1].strip(), "toml_key", k)


def json_file(out: Out, text: str) -> None:
    plain = re.sub(r"(?m)^\s*//.*$", "", text)
    data = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain))
    if not isinstance(data, dict):
        return
    if "openapi" in data or "swagger" in data:
        openapi(out, data)
        return
    for key in data:
        at = plain.find(json.dumps(key))
        out.node(key, "json_key", plain.count("\n", 0, max(at, 0)) + 1)


def openapi(out: Out, data: dict) -> None:
    for name, body in ((data.get("components") or {}).get("schemas") or data.get("definitions") or {}).items():
        sid = out.node(name, "struct", 1, origin="openapi")
        for field in (body or {}).get("properties") or {}:
            out.edge(sid, out.node(f"{name}.{field}", "schema_field", 1), "has_field")
    for path, item in (data.get("paths") or {}).items():
        for method, op in (item or {}).items():
            if method in ("get", "post", "put", "delete", "patch", "head", "options") and isinstance(op, dict):
                eid = out.node(f"{method.upper()} {path}", "api_endpoint", 1, http_method=method.upper(), http_path=path, operation_id=op.get("operationId"))
                for ref in sorted(set(re.findall(r'"\$ref":\s*"#/(?:components/schemas|definitions)/([^"]+)"', json.dumps(op)))):
                    out.edge(eid, out.id(ref, "struct"), "depends_on")


def openapi_yaml(out: Out, text: str) -> None:
    """Paths, methods, operation ids, schemas and references by indentation."""
    lines, section, path, endpoint, schemas = text.splitlines(), None, None, None, None
    for k, line in enumerate(lines, 1):
        m = re.match(r"( *)([^\s#:][^:]*):\s*(.*)$", line)
        indent, key = (len(m[1]), m[2].strip("\"' ")) if m else (None, None)
        if indent == 0:
            section, path, endpoint, schemas = key, None, None, None
        elif section == "paths" and key and key.startswith("/"):
            path = key
        elif section == "paths" and path and key in ("get", "post", "put", "delete", "patch", "head", "options"):
            operation = next((re.match(r"\s*operationId:\s*(\S+)", x)[1] for x in lines[k : k + 12] if re.match(r"\s*operationId:\s*(\S+)", x)), None)
            endpoint = out.node(f"{key.upper()} {path}", "api_endpoint", k, http_method=key.upper(), http_path=path, operation_id=operation)
        elif section == "components" and key == "schemas":
            schemas = indent
        elif section == "components" and schemas is not None and m and indent == schemas + 2:
            out.node(key, "struct", k, origin="openapi")
        if endpoint and (ref := re.search(r"\$ref:\s*[\"']?#/components/schemas/(\w+)", line)):
            out.edge(endpoint, out.id(ref[1], "struct"), "depends_on")


class _Html(HTMLParser):
    def __init__(self, out: Out):
        super().__init__()
        self.out = out

    def handle_starttag(self, tag, attrs):
        at, by = self.getpos()[0], dict(attrs)
        if by.get("id"):
            self.out.node(by["id"], "html_id", at)
        if tag == "script" and by.get("src"):
            self.out.edge(self.out.node(by["src"], "html_script", at), self.out.id(by["src"], "module"), "depends_on")
        if tag == "template":
            self.out.node(by.get("id") or f"template:{at}", "html_template", at)


def html(out: Out, text: str) -> None:
    _Html(out).feed(text)


def hcl(out: Out, text: str) -> None:
    src = lexing.read(text, "hash")
    known = {"resource", "data", "module", "variable", "output", "provider", "locals", "terraform"}
    for m in re.finditer(r"(?m)^(\w+)((?:\s+\"[^\"]*\")*)\s*\{", src.text):
        if m[1] in known:
            labels = re.findall(r'"([^"]*)"', m[2])
            end = lexing.close(src.text, m.end() - 1)
            hid = out.node(".".join(labels) or m[1], f"tf_{m[1]}", src.text.count("\n", 0, m.start()) + 1, src.text.count("\n", 0, max(end, 0)) + 1)
            for ref in sorted(set(re.findall(r"\b(?:var|module|data)\.([\w.]+)", src.text[m.end() : end]))):
                out.edge(hid, out.id(ref.split(".")[0], "tf_variable"), "depends_on")


def markdown(out: Out, text: str) -> None:
    for c in chunks(text):
        if c["heading_text"]:
            line = text.encode()[: c["byte_offset"]].decode("utf-8", "ignore").count("\n") + 1
            sid = out.node(c["heading_text"], "markdown_section", line, signature=" > ".join(c["heading_hierarchy"]), body=c["content"])
            if c["parent_heading"]:
                out.edge(out.id(c["parent_heading"], "markdown_section"), sid, "defines")
            for link in c["links"]:
                if re.search(r"(?i)\.mdx?(?:#|$)", link["dest"]) and "://" not in link["dest"]:
                    out.edge(sid, out.id(link["dest"].split("#")[0], "module"), "references")


PARSERS: dict[str, Callable[[Out, str], None]] = {
    "python": python, "sql": sql, "proto": proto, "graphql": graphql, "json": json_file, "toml": toml, "yaml": yaml, "html": html, "hcl": hcl, "markdown": markdown, "dockerfile": dockerfile,
}


def language_of(file: str) -> str | None:
    name = file.rsplit("/", 1)[-1]
    if re.fullmatch(r"(?:Dockerfile|Containerfile)(?:\..+)?|.+\.[Dd]ockerfile", name):
        return "dockerfile"
    return LANGUAGES.get(name.rpartition(".")[2].lower())


def extract_file(root: str, file: str, text: str, language: str | None = None) -> list[tuple]:
    """The rows of one file; an error becomes a row of its own."""
    language = language_of(file) or (language or "").strip().lower() or None
    if not language or not text:
        return []
    out, text = Out(root, file, language), text.removeprefix("\ufeff")
    try:
        PARSERS.get(language, _lexed)(out, text)
    except Exception as e:  # noqa: BLE001
        try:
            if language == "python":
                out.rows.clear()
                _lexed(out, text)
                return out.rows
        except Exception:  # noqa: BLE001
            pass
        return [("error", root, file, type(e).__name__, None, language, None, None, str(e)[:500], None, {}, None, None)]
    return out.rows


def extract(files: DataFrame) -> DataFrame:
    """Rows (what: node, edge or error) of files (root, file, language, body), file by file in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.split(r", (?=\w+ )", ROWS)]
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                rows = [r for root, file, language, body in zip(part["root"], part["file"], part["language"], part["body"], strict=True) for r in extract_file(root, file or "", body, language)]
                frame = pd.DataFrame(rows, columns=names)
                for c in ("line_start", "line_end"):
                    frame[c] = frame[c].astype("Int32")
                yield frame

    return spread(files.where("body is not null and body <> ''").select("root", "file", "language", "body")).mapInPandas(run, ROWS)


def nodes_of(rows: DataFrame) -> DataFrame:
    """Nodes by id (of several, the lowest line)."""
    from pyspark.sql import functions as F

    n = rows.where("what = 'node'").withColumn("id", F.concat_ws(":", "root", "file", "name", "kind"))
    cols = ["root", "file", "name", "kind", "language", "line_start", "line_end", "signature", "body", "metadata"]
    return n.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("line_start", "line_end", F.length("signature"))).alias("r")).select("id", "r.*")


def edges_of(rows: DataFrame) -> DataFrame:
    """Distinct edges: source_id, target_id, edge_type."""
    from pyspark.sql import functions as F

    return rows.where("what = 'edge'").select(F.col("name").alias("source_id"), F.col("target").alias("target_id"), "edge_type").distinct()
