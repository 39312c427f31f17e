"""A lexer for source text: comment and string spans, tokens, function and decorator spans.

It knows the lexical rules of Python and of the families around C, Rust, Go,
Java and JavaScript; other extensions are read by the C-like rules.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

#: File extension to lexical family.
FAMILY = {
    "py": "python", "pyi": "python", "pyw": "python", "sh": "hash", "bash": "hash", "rb": "hash", "yaml": "hash", "yml": "hash", "toml": "hash",
    "rs": "rust", "go": "go", "java": "java", "kt": "java", "kts": "java", "scala": "java", "cs": "java", "swift": "java",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "javascript", "tsx": "javascript",
    "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c",
}
#: Language names to family, for files without a known extension.
LANGUAGE = {"python": "python", "rust": "rust", "go": "go", "golang": "go", "java": "java", "kotlin": "java", "javascript": "javascript", "js": "javascript", "typescript": "javascript", "ts": "javascript", "c": "c", "c++": "c", "bash": "hash", "shell": "hash", "ruby": "hash"}

_LINE, _BLOCK = r"(?P<c1>//[^\n]*)", r"(?P<c2>/\*(?:[\s\S]*?\*/|[\s\S]*\Z))"
_DQ, _SQ = r'"(?:\\[\s\S]|[^"\\\n])*"', r"'(?:\\[\s\S]|[^'\\\n])*'"
_TICK = r"`(?:\\[\s\S]|[^`\\])*`"
_REGEX = r"(?:(?<=[=(,:\[!&|?{};])|(?<=[=(,:\[!&|?{};] )|(?<=return ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_SPANS = {
    "python": rf"(?P<c1>\#[^\n]*)|(?P<s>(?:\b[rRbBuUfFtT]{{1,2}})?(?:\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|{_DQ}|{_SQ}))",
    "hash": rf"(?P<c1>\#[^\n]*)|(?P<s>{_DQ}|{_SQ})",
    "rust": rf"{_LINE}|{_BLOCK}|(?P<s>\bb?r(?P<h>\#*)\"[\s\S]*?\"(?P=h)|\"(?:\\[\s\S]|[^\"\\])*\"|'(?:\\[^\n']+|\\'|[^\\'\n])')",
    "go": rf"{_LINE}|{_BLOCK}|(?P<s>{_DQ}|{_SQ}|`[^`]*`)",
    "java": rf"{_LINE}|{_BLOCK}|(?P<s>\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|{_DQ}|{_SQ})",
    "javascript": rf"{_LINE}|{_BLOCK}|(?P<s>{_DQ}|{_SQ}|{_TICK}|{_REGEX})",
    "c": rf"{_LINE}|{_BLOCK}|(?P<s>{_DQ}|{_SQ})",
}
_SPAN_RE = {k: re.compile(v) for k, v in _SPANS.items()}


def family(file: str | None, language: str | None) -> str:
    """The lexical family: by the extension, else by the language's name, else "c"."""
    ext = (file or "").rpartition("/")[2].rpartition(".")[2].lower()
    return FAMILY.get(ext) or LANGUAGE.get((language or "").strip().lower(), "c")


@dataclass
class Source:
    """A text with its comment and string spans; ``masked`` has both blanked, line ends kept."""

    text: str
    kind: str
    spans: list  # (start, end, "c" or "s")
    masked: str
    starts: list  # offset of each line

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1


_NOT_NL = re.compile(r"[^\n]")


def _nested_end(text: str, start: int) -> int:
    """End of a Rust block comment, which may hold others."""
    depth = 0
    for m in re.finditer(r"/\*|\*/", text[start:]):
        depth += 1 if m[0] == "/*" else -1
        if depth == 0:
            return start + m.end()
    return len(text)


def read(text: str, kind: str) -> Source:
    """CRLF counts as one line end; a byte-order mark counts as white space."""
    text = text.replace("\r\n", "\n")
    if text.startswith("\ufeff"):
        text = " " + text[1:]
    spans, pos, rx = [], 0, _SPAN_RE[kind]
    while m := rx.search(text, pos):
        a, b, what = m.start(), m.end(), "s" if m["s"] is not None else "c"
        if kind == "rust" and what == "c" and text.find("/*", a + 2, b) >= 0 and text.startswith("/*", a):
            b = _nested_end(text, a)
        spans.append((a, b, what))
        pos = max(b, a + 1)
    out, last = [], 0
    for a, b, _ in spans:
        out.append(text[last:a])
        piece = text[a:b]
        out.append(" " * (b - a) if "\n" not in piece else _NOT_NL.sub(" ", piece))
        last = b
    out.append(text[last:])
    starts = [0]
    find = text.find
    at = find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = find("\n", at + 1)
    return Source(text, kind, spans, "".join(out), starts)


_PAIRS = {"(": ")", "[": "]", "{": "}"}


def close(masked: str, at: int, limit: int = 1 << 30) -> int:
    """Offset behind the bracket that closes the one at ``at``; -1 if there is none."""
    depth, n = 0, min(len(masked), at + limit)
    for m in _BRACKET.finditer(masked, at, n):
        depth += 1 if m[0] in "([{" else -1
        if depth == 0:
            return m.end()
    return -1


_BRACKET = re.compile(r"[()\[\]{}]")
_W = r"[A-Za-z_$\u00c0-\uffff][\w$]*"
_DEFS = {
    "python": re.compile(rf"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>{_W})[ \t]*[\[(]", re.M),
    "rust": re.compile(rf"\bfn\s+(?:r\#)?(?P<n>{_W})\s*(?=[<(])"),
    "go": re.compile(rf"^func\s+(?:\([^)]*\)\s*)?(?P<n>{_W})\s*(?=[\[(])", re.M),
    "java": re.compile(rf"(?<=[\w>\]?])\s+(?P<n>{_W})\s*\("),
    "javascript": re.compile(
        rf"\bfunction\b\s*\*?\s*(?P<n>{_W})\s*(?=[<(])"
        rf"|\bconst\s+(?P<a>{_W})\s*(?P<t>:[^=;]*?(?:=>[^=;]*?)?)?=\s*(?:async\b\s*)?(?=[(<]|{_W}\s*=>)"
        rf"|(?:^|[;{{}}])[ \t]*(?:(?:public|private|protected|static|async|override|readonly|abstract|declare|get|set)\b[ \t]+)*\*?[ \t]*\#?(?P<m>{_W})[ \t]*(?=[<(])",
        re.M,
    ),
    "hash": re.compile(rf"^[ \t]*(?:function[ \t]+|def[ \t]+)(?P<n>{_W})", re.M),
    "c": re.compile(rf"(?<=[\w*&>])\s+\**(?P<n>{_W})\s*\("),
}
#: Words that stand before "(" without being a function's name.
NOT_NAMES = frozenset("if for while switch catch return new throw else do try case with function super this typeof await yield sizeof assert synchronized match loop unsafe in of instanceof delete void import require".split())
#: Words that cannot be a return type or modifier right before a method's name.
NOT_TYPES = frozenset("return new throw else case do in of instanceof await yield typeof delete void_ import package goto assert".split())


@dataclass
class Function:
    name: str
    at: int  # offset of the name
    start: int  # offset of the definition's first line
    head_end: int  # offset behind the parameters
    end: int  # offset behind the body


_GENERIC = re.compile(r"[<>()\[\]{};]")


def _generic_end(masked: str, at: int) -> int:
    """Behind a <...> list that starts at ``at``; -1 if the statement ends before it does."""
    depth, nested = 0, 0
    for m in _GENERIC.finditer(masked, at):
        ch, k = m[0], m.start()
        if ch in "([{":
            nested += 1
        elif ch in ")]}":
            nested -= 1
            if nested < 0:
                return -1
        elif ch == ";":
            if not nested:
                return -1
        elif ch == "<":
            depth += 1
        elif masked[k - 1] not in "-=":
            depth -= 1
            if depth == 0:
                return k + 1
    return -1


#: What may stand between a script function's parameters and its arrow or body, and behind the parameters of C-like functions.
_ARROW = re.compile(r"\s*(?::[^;{=]*(?:\{[^}]*\}[^;{=]*)?)?=>")
_METHOD_TAIL = re.compile(r"\s*(?::\s*[^;{}()=]*(?:\{[^}]*\}[^;{}()=]*)?)?\{")
_C_TAIL = re.compile(r"\s*(?:const\b\s*|noexcept\b\s*|throws\b[\w\s.,<>]*|default\b[^;{]*)?([{;=:])")
_DECLARED = re.compile(r"[ \t]*(?:@\w+[ \t]+)*(?:[\w<>\[\],.?]+[ \t]+)+")
_LAST_WORD = re.compile(r"[\w$]")


def _word_before(masked: str, at: int) -> str:
    """The word that ends before the white space in front of ``at``."""
    end = at
    while end and masked[end - 1].isspace():
        end -= 1
    start = end
    while start and _LAST_WORD.match(masked, start - 1):
        start -= 1
    return masked[start:end]


def _statement_before(masked: str, at: int) -> str:
    """The text from the last line end, brace or semicolon to ``at``."""
    return masked[max(masked.rfind(ch, 0, at) for ch in ";{}\n") + 1 : at]


def functions(src: Source) -> list[Function]:
    """The functions and methods defined in a text, in order."""
    masked, kind, out, seen = src.masked, src.kind, [], set()
    for m in _DEFS[kind].finditer(masked):
        group = next(g for g in ("n", "a", "m") if g in m.groupdict() and m[g] is not None)
        name, at = m[group], m.start(group)
        if name in NOT_NAMES or at in seen:
            continue
        p = m.end(group)
        while p < len(masked) and masked[p] in " \t\n":
            p += 1
        if group == "a":
            p = m.end()
            if p < len(masked) and masked[p] == "<":
                p = _generic_end(masked, p)
            if p < 0 or p >= len(masked):
                continue
            if masked[p] == "(":
                q = close(masked, p)
                if q < 0 or not _ARROW.match(masked, q):
                    continue
                head = q
            else:
                head = masked.find("=>", p)
            body = masked.find("=>", head if head > 0 else p) + 2
            b = body
            while b < len(masked) and masked[b] in " \t\n":
                b += 1
            end = close(masked, b) if b < len(masked) and masked[b] in "{(" else _statement_end(masked, b)
            out.append(Function(name, at, m.start(), head, end if end > 0 else len(masked)))
            seen.add(at)
            continue
        if p < len(masked) and masked[p] in "<[" and kind != "java":
            p = _generic_end(masked, p) if masked[p] == "<" else close(masked, p)
            if p < 0:
                continue
            while p < len(masked) and masked[p] in " \t\n":
                p += 1
        if kind == "hash":
            head = p
        else:
            if p >= len(masked) or masked[p] != "(":
                continue
            head = close(masked, p)
            if head < 0:
                continue
        if kind in ("java", "c"):
            word = _word_before(masked, at)
            if word in NOT_TYPES or word.isdigit():
                continue
            tail = _C_TAIL.match(masked, head)
            if not tail or tail[1] in "=:":
                continue
            if tail[1] == ";" and not _DECLARED.fullmatch(_statement_before(masked, at)):
                continue
            if tail[1] == ";" and kind == "c":
                continue
            if tail[1] == ";" and _inside_call(masked, at):
                continue
        elif group == "m":
            if not _METHOD_TAIL.match(masked, head):
                continue
        end = _body_end(src, head, at)
        start = src.starts[src.line(m.start("n") if group == "n" else at)]
        out.append(Function(name, at, start, head, end))
        seen.add(at)
    return out


def _inside_call(masked: str, at: int) -> bool:
    """Whether the text before on the same statement is an assignment or expression."""
    before = masked[masked.rfind("\n", 0, at) + 1 : at]
    return "=" in before or "(" in before.replace("@", "", 1) and not before.lstrip().startswith("@")


def _statement_end(masked: str, at: int) -> int:
    depth = 0
    for k in range(at, len(masked)):
        ch = masked[k]
        if ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
            if depth < 0:
                return k
        elif ch == ";" and depth == 0:
            return k + 1
        elif ch == "\n" and depth == 0 and k > at:
            return k
    return len(masked)


def _body_end(src: Source, head: int, at: int) -> int:
    masked = src.masked
    if src.kind == "python":
        line = src.line(at)
        first = masked[src.starts[line] : at]
        indent = len(first) - len(first.lstrip(" \t"))
        colon = masked.find(":", head)
        k = src.line(colon if colon >= 0 else head) + 1
        last = k
        while k < len(src.starts):
            row = masked[src.starts[k] : src.starts[k + 1] if k + 1 < len(src.starts) else len(masked)]
            raw = src.text[src.starts[k] : src.starts[k] + len(row)]
            if raw.strip():
                # text inside a string may stand anywhere; a comment out here belongs to what follows
                if row.strip() and len(row) - len(row.lstrip(" \t")) <= indent:
                    break
                if row.strip() or not raw.lstrip().startswith("#") or len(raw) - len(raw.lstrip(" \t")) > indent:
                    last = k + 1
            k += 1
        return src.starts[last] if last < len(src.starts) else len(masked)
    brace = masked.find("{", head)
    semi = masked.find(";", head)
    if brace < 0 or 0 <= semi < brace:
        return semi + 1 if semi >= 0 else head
    end = close(masked, brace)
    return end if end > 0 else len(masked)


_DECORATOR = {
    "python": re.compile(r"^[ \t]*@[^\n]*", re.M),
    "java": re.compile(r"^[ \t]*@(?!interface\b)[\w.]+[ \t]*", re.M),
    "javascript": re.compile(r"^[ \t]*@[\w.$]+[ \t]*", re.M),
    "rust": re.compile(r"^[ \t]*#!?\[", re.M),
    "c": re.compile(r"^[ \t]*\[\[", re.M),
}


def decorator_lines(src: Source) -> set[int]:
    """The lines that hold nothing but decorators, annotations or attributes."""
    rx, out, masked = _DECORATOR.get(src.kind), set(), src.masked
    if rx is None:
        return out
    for m in rx.finditer(masked):
        end = m.end()
        if src.kind == "rust":
            end = close(masked, masked.find("[", m.start()))
        elif src.kind == "python":
            p = masked.find("(", m.start(), m.end())
            end = close(masked, p) if p >= 0 else m.end()
        elif end < len(masked) and masked[end] == "(":
            end = close(masked, end)
        if end < 0:
            continue
        line_end = masked.find("\n", end)
        rest = masked[end : line_end if line_end >= 0 else len(masked)].strip()
        while rest and src.kind != "python" and (rest.startswith("@") or rest.startswith("#[")):
            nxt = re.match(r"@[\w.$]+[ \t]*(\([^()]*\))?|#\[[^\]]*\]", rest)
            if not nxt:
                break
            rest = rest[nxt.end() :].strip()
        if not rest:
            out.update(range(src.line(m.start() + len(m[0]) - len(m[0].lstrip())), src.line(max(end - 1, m.start())) + 1))
    return out


@lru_cache(maxsize=4096)
def words(text: str) -> tuple[str, ...]:
    """Lower-case words of a name or text; snake and camel case are split."""
    return tuple(w.lower() for w in re.findall(r"[A-ZÀ-Þ]+(?![a-zà-ÿ])|[A-ZÀ-Þ]?[a-zà-ÿ]+|\d+", text))
