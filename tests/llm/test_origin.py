"""Generated, minified, third-party and data files by case, and copies over a corpus."""

import pytest

from skein.llm import origin

CODE = "def seal(tray):\n    if not tray:\n        raise ValueError('x')\n    for item in tray:\n        item.close()\n    return tray\n"
JS = "export function seal(tray) {\n  if (!tray) {\n    throw new Error('x');\n  }\n  for (const item of tray) {\n    item.close();\n  }\n  return tray;\n}\n"
MIN = "!function(e){" + "".join(f"var a{i}=e?{i}:n;if(a{i}){{b(a{i})}}" for i in range(60)) + "}(i);"

CASES = [
    ("src/a.py", CODE, "hand_written"), ("src/a.js", JS, "hand_written"), ("a.py", None, "hand_written"), ("a.py", " \n", "hand_written"), (None, CODE, "hand_written"),
    ("src/a.py", "# Code generated by loom. DO NOT EDIT.\n" + CODE, "generated"), ("src/a.js", JS + "// @generated by loom from a.schema\n", "generated"), ("a.js", "// Automatisch erzeugt von x - nicht bearbeiten\n" + JS, "generated"),
    ("a.py", "# Not generated: please edit freely.\n" + CODE, "hand_written"), ("a.py", "BANNER = 'Code generated by loom. DO NOT EDIT.'\n" + CODE, "hand_written"), ("a.js", '// sample: "@generated by loom"\n' + JS, "hand_written"),
    ("a.py", "# This module generates the bindings; it is itself maintained by hand.\n" + CODE, "hand_written"), ("a.js", "/** Auto-generated method stub */\n" + JS, "hand_written"),
    ("src/gen/a.py", CODE, "generated"), ("src/generator/a.py", CODE, "hand_written"), ("cmd/gen_docs/a.py", CODE, "hand_written"), ("a_pb2.py", CODE, "generated"), ("a.g.ts", JS, "generated"),
    ("vendor/x/a.py", CODE, "vendored"), ("src/vendors/a.py", CODE, "hand_written"), ("src/vendor_portal/a.py", CODE, "hand_written"), ("node_modules/x/a.js", JS, "vendored"), ("deps/x-1.2/a.js", JS, "vendored"),
    ("src/a.js", "// x v1.2 - bundled copy, see upstream project for history\n" + JS, "vendored"), ("a.py", "# Vendors send us lists; this reads them.\n" + CODE, "hand_written"),
    ("src/a.js", MIN, "minified"), ("src/min_a.js", JS, "hand_written"), ("src/a.js", "// vector: " + "ab12cd34 " * 300 + "\n" + JS, "hand_written"),
    ("src/a_data.py", "X = [\n" + "".join(f"    [{i}, {i}.5, 'ab{i}'],\n" for i in range(99)) + "]\n", "data"), ("src/a.go", 'package data\n\nvar T = "' + "QUJD" * 500 + '"\n', "data"), ("src/a_data.py", CODE, "hand_written"),
]


@pytest.mark.parametrize("file,text,want", CASES)
def test_origin(file, text, want):
    assert origin.origin(text, file, None)[0] == want


def test_uniform_runs_are_generated():
    text = "".join(f"    table.put(key{i}, value{i});\n" for i in range(60))
    assert origin.origin("class A {\n" + text + "}\n", "A.java", None)[:2] == ("generated", "uniform")


def test_copies_and_distinct_rows(spark):
    body = "\n".join(f"def seal_{i}(tray):\n    return tray.close({i})\n" for i in range(20))
    rows = [("r", "vendor/x/a.py", "module", None, body), ("q", "src/mine.py", "module", None, "# my own file\n" + body.replace("    ", "  ")), ("q", "src/other.py", "module", None, CODE), ("q", "src/other.py", "module", None, CODE), ("q", None, "module", None, None), ("q", "src/f.py", "function", None, body)]
    nodes = spark.createDataFrame(rows, "root string, file string, kind string, language string, body string")
    assert {tuple(r) for r in origin.found(nodes).collect()} == {("r", "vendor/x/a.py"), ("q", "src/mine.py")}
    assert {tuple(r) for r in origin.hand_written(nodes).collect()} == {("q", "src/other.py"), ("q", None)}
    assert origin.found(nodes.where("false")).collect() == []
