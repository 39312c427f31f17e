"""Function and documentation spans, their match, and triviality, by case."""

import pytest

from skein.llm import docpairs
from skein.llm.triviality import is_trivial

INFO = "Blocks until the lane has settled, or gives up after nine attempts."


def found(text, file):
    return [(p["name"], p["line_start"]) for p in docpairs.pairs(text, file, None) if not p["trivial"]]


CASES = [
    ("a.py", f"# {INFO}\ndef f(x):\n    return x\n", [("f", 2)]),
    ("a.py", f"# {INFO}\n\ndef f(x):\n    return x\n", []),
    ("a.py", f"# {INFO}\n@cached(\n    1,\n)\n@other\ndef f(x):\n    return x\n", [("f", 6)]),
    ("a.py", f"@other\n# {INFO}\ndef f(x):\n    return x\n", [("f", 3)]),
    ("a.py", f"# {INFO}\nX = 1\ndef f(x):\n    return x\n", []),
    ("a.py", f'# TODO\ndef f(x):\n    """{INFO}"""\n    return x\n', []),
    ("a.py", f'def f(x):\n    r"""\n    {INFO}\n    """\n    return x\n', [("f", 1)]),
    ("a.py", f"def f(x): '{INFO}'\n", [("f", 1)]),
    ("a.py", f'def f(x):\n    f"""{INFO}"""\n    return x\n', []),
    ("a.py", f'def f(x):\n    """{INFO}""".strip()\n    return x\n', []),
    ("a.py", f'def f(x):\n    y = 1\n    """{INFO}"""\n    return x\n', []),
    ("a.py", f'def f(\n    x: dict[str, int] = {{"a": 1}},\n) -> int:\n    # note\n    """{INFO}"""\n', [("f", 1)]),
    ("a.py", f'class A:\n    """{INFO}"""\n    def f(self):\n        pass\n', []),
    ("a.py", f"T = '''\n# {INFO}\ndef f(x):\n    pass\n'''\n", []),
    ("a.py", f"# {INFO}\r\ndef f(x):\r\n    pass\r\n", [("f", 2)]),
    ("a.py", f"\ufeff# {INFO}\ndef f(x):\n    pass\n", [("f", 2)]),
    ("a.py", "#!/usr/bin/env python3\ndef f(x):\n    pass\n", []),
    ("a.py", f"x = 1  # {INFO}\ndef f(x):\n    pass\n", []),
    ("a.py", f"async def g():\n    # {INFO}\n    async def f():\n        pass\n", [("f", 3)]),
    ("a.rs", f"/// {INFO}\n#[inline]\n#[cfg(\n  test\n)]\npub async fn f<'a>(x: &'a str) -> u8 {{ 1 }}\n", [("f", 6)]),
    ("a.rs", f'const T: &str = r#"\n/// {INFO}\nfn f() {{}}\n"#;\n', []),
    ("a.rs", f"/* a /* b */ {INFO} */\nfn f() {{}}\n", [("f", 2)]),
    ("a.go", f"// {INFO}\nfunc (t *T) F(a int) (int, error) {{\n}}\n", [("F", 2)]),
    ("a.java", f"class A {{\n  /** {INFO} */\n  @Deprecated\n  @X(a = 1) public static <T> List<T> f(\n    int a) throws E {{\n  }}\n  int b = g(1);\n}}\n", [("f", 4)]),
    ("a.java", f"interface A {{\n  /** {INFO} */\n  int f(int a);\n}}\n", [("f", 3)]),
    ("a.ts", f"/** {INFO} */\nexport const f = async (a: number): Promise<number> => {{\n}};\n", [("f", 2)]),
    ("a.ts", f"class A {{\n  /** {INFO} */\n  private async f(\n    a: B[]): Promise<void> {{\n    // {INFO}\n    if (a) {{ }}\n    // {INFO}\n    g(a);\n  }}\n}}\n", [("f", 3)]),
    ("a.js", f"// {INFO}\nconst f = (a) => a + 1;\n// {INFO}\nconst g = 3;\n", [("f", 2)]),
    ("a.js", f"// {INFO}\nfunction* f(a) {{ }}\nconst s = `// {INFO}\nfunction g() {{}}`;\n", [("f", 2)]),
    ("a.js", "/*! lib v12 */\nfunction t(g){return g}function u(v){}\n", []),
    ("a.js", f"// {INFO}\na; function f() {{ }}\n", []),
    ("a.py", "", []),
]


@pytest.mark.parametrize("file,text,want", CASES)
def test_match(file, text, want):
    assert found(text, file) == want


TRIVIAL = [
    "", "   ", "/** */", "// ------", "# ======", "TODO", "FIXME: add description", "???", "Parse pallet.", "This function is used to parse pallet.", "parse_pallet()", "parse_pallet -- parse_pallet",
    "@param x the x\n@return the result", ":param x:\n:return:", "Args:\n    x: the x\nReturns:", "Gets the x.", "See above.", "Beschreibung folgt", "por documentar", "à documenter plus tard",
    "eslint-disable-next-line", "noqa: E501", "clippy::all", "{@inheritDoc}", "<summary></summary>", "if (x > 3) { fold(); }", "let old = load(x);", "return scan_scan(x, 3)", "SPDX-License-Identifier: X-1",
    "Auto-generated method stub", "Same as the other overload.", "[method description]", "constructor", "Documentation to be written by whoever touches this next.",
]
TELLING = [
    INFO, "Returns -1 if the tray is closed.", "TODO: handle a frozen lane too", "Darf nur aufgerufen werden, wenn der x bereits gesperrt ist.", "No modifica el original; trabaja siempre sobre una copia.",
    "Renvoie une liste vide lorsque le x a déjà été fermé par un autre fil.", "@param x index of the lane to start from, counted from zero", "Parse pallet.\nKeeps at most 9 lanes in memory.",
]


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial(doc):
    assert is_trivial(doc, "parse_pallet", "def parse_pallet(x)")


@pytest.mark.parametrize("doc", TELLING)
def test_telling(doc):
    assert not is_trivial(doc, "parse_pallet", "def parse_pallet(x)")


NODE = "root string, file string, kind string, language string, body string, name string"


def test_operator(spark):
    text = f"# {INFO}\ndef f(x):\n    return x\n"
    rows = [("r", "a.py", "module", None, text, None), ("r", "a.py", "module", "python", text, None), ("r", "b.py", "module", None, None, None), ("r", "c.py", "module", None, "", None), ("r", "d.py", "function", None, text, None), (None, None, "module", "Python", text, None), ("r", "long.py", "module", None, "x = 1\n" * 50_000 + text, "n")]
    nodes = spark.createDataFrame(rows, NODE)
    got = {tuple(r) for r in docpairs.found(nodes).collect()}
    assert got == {("r", "a.py", "f", 2), (None, None, "f", 2), ("r", "long.py", "f", 50_002)}
    assert docpairs.found(nodes.where("false")).collect() == []


def test_pairs_with_symbols(spark):
    text = f"# {INFO}\ndef f(x):\n    return x\n\n# {INFO}\ndef g():\n    return 1\n\n# {INFO}\ndef h():\n    return 1\n"
    nodes = spark.createDataFrame([("r", "a.py", "module", None, text, None)], NODE)
    symbols = spark.createDataFrame([("r", "a.py", "f", "function", f"# {INFO}", 1, 1), ("r", "a.py", "f", "function", "old", 9, 0), ("r", "a.py", "g", "function", "Other text.", 1, 1), ("r", "a.py", "h", "function", None, 1, 1)], "root_id string, file_path string, name string, kind string, doc_comment string, updated_at long, scan_version long")
    rows = {r["name"]: r for r in docpairs.code_description_pairs(nodes, symbols).collect()}
    assert {k: r["doc_status"] for k, r in rows.items()} == {"f": "same", "g": "stale", "h": "missing"}
    assert rows["f"]["description"] == INFO and rows["f"]["body"] == "def f(x):\n    return x\n" and rows["f"]["signature"] == "def f(x)"
