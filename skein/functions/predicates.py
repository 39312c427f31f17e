"""Filters of search and ranking as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein import schema


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def equals_ignoring_case(col, value: str) -> Column:
    """kind or language."""
    return F.lower(_c(col)) == value.lower()


def file_contains(col, part: str) -> Column:
    """case counts."""
    return _c(col).contains(part)


def in_root(col, root: str | None, other_roots: list[str] | None = None) -> Column:
    """the root ignoring case, external symbols, or roots without code; None and "all" pass everything."""
    if root is None or root.lower() == "all":
        return F.lit(True)
    c = _c(col)
    return (F.lower(c) == root.lower()) | (c == "external") | c.isin(other_roots or [])


def result_in_root(id_col, kind_col, root: str | None) -> Column:
    """results that are no code pass; the root of code is the text before the first colon."""
    if root is None or root.lower() == "all":
        return F.lit(True)
    return ~_c(kind_col).startswith("code:") | (F.lower(F.split_part(_c(id_col), F.lit(":"), F.lit(1))) == root.lower())


def synthetic_is(col, value: bool) -> Column:
    """missing counts as false."""
    return F.coalesce(_c(col), F.lit(False)) == value


def at_least_complex(kind, cyclomatic, least: int) -> Column:
    """functions only; a missing value fails."""
    return (_c(kind) == "function") & F.coalesce(_c(cyclomatic) >= least, F.lit(False))


def in_subsystem(col, wanted: str) -> Column:
    """the subsystem or one below it, ignoring case."""
    c = F.lower(_c(col))
    return (c == wanted.lower()) | c.startswith(wanted.lower() + "/")


def path_and_name(query: str) -> tuple[str, str] | None:
    """a query split at the last slash; an empty half is none."""
    path, slash, name = query.rpartition("/")
    return (path, name) if slash and path and name else None


def name_or_signature(name, signature, query: str) -> Column:
    """ignoring case."""
    q = query.lower()
    return F.lower(_c(name)).contains(q) | F.coalesce(F.lower(_c(signature)).contains(q), F.lit(False))


def like_literal(col, part: str) -> Column:
    """LIKE %part% with ! as escape."""
    escaped = part.replace("!", "!!").replace("%", "!%").replace("_", "!_")
    return F.like(_c(col), F.lit(f"%{escaped}%"), F.lit("!"))


def simple_glob(path, pattern) -> Column:
    """no star: equal; one: prefix and suffix; more: prefix. Both sides may be columns."""
    p, g = _c(path), _c(pattern)
    stars = F.length(g) - F.length(F.replace(g, F.lit("*"), F.lit("")))
    head = F.split_part(g, F.lit("*"), F.lit(1))
    return F.when(stars == 0, p == g).when(stars == 1, p.startswith(head) & p.endswith(F.split_part(g, F.lit("*"), F.lit(2)))).otherwise(p.startswith(head))


def is_test_path(col) -> Column:
    """by directory or file name."""
    p = _c(col)
    name = F.element_at(F.split(p, "/"), -1)
    parts = [p.contains(x) for x in (".test.", ".spec.", "_test.", "_tests.", "_spec.", "/test/", "/tests/", "/fixtures/", "/fixture/")]
    parts += [p.startswith(x) for x in ("test/", "tests/", "fixtures/", "fixture/")]
    parts += [name.startswith("test_"), name.contains("smoke"), name.contains("bench")]
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False))


def is_test_function(kind, flag, decorators, file) -> Column:
    """the flag, a test decorator, or the path."""
    tokens = F.split(F.coalesce(_c(decorators), F.lit("")), r"[,\s]")
    marked = F.arrays_overlap(tokens, F.array(F.lit("test"), F.lit("tokio::test")))
    return (_c(kind) == "function") & (F.coalesce(_c(flag), F.lit(False)) | marked | is_test_path(file))


def is_trait_method(kind, name) -> Column:
    """F15."""
    return (_c(kind) == "function") & F.lower(_c(name)).isin(schema.TRAIT_METHODS)


def kind_rank(kind) -> Column:
    """F16: 0 definitions, 1 others, 2 imports and modules."""
    return F.when(_c(kind).isin(schema.PRIMARY_KINDS), 0).when(_c(kind).isin(schema.REFERRING_KINDS), 2).otherwise(1)


def shown_in_traversal(kind) -> Column:
    """F17."""
    return ~_c(kind).isin(schema.HIDDEN_IN_TRAVERSAL)


def embeddable(kind) -> Column:
    """every kind but a few."""
    return ~_c(kind).isin(schema.NOT_EMBEDDED)


def shown_importance(importance, test) -> Column:
    """importance after the demotion of tests."""
    return F.when(test, _c(importance) * schema.TEST_DEMOTION).otherwise(_c(importance))


def looks_like_url_path(name) -> Column:
    """F21."""
    return _c(name).startswith("/") & (F.length(_c(name)) > 1)


def is_generated_sdk(file) -> Column:
    """F22."""
    name = F.lower(F.element_at(F.split(_c(file), "/"), -1))
    parts = [name.contains(x) for x in ("sdk.gen", ".generated.", "_generated.", "generated_client", "openapi_client")]
    return reduce(lambda a, b: a | b, parts) | name.startswith("api_client.")


def language_family(language) -> Column:
    """languages that import each other share a family."""
    low = F.lower(_c(language))
    return F.when(low.rlike("typescript|javascript|tsx|jsx"), "ecmascript").otherwise(low)


def normalized_route(path) -> Column:
    """Route parameters in any notation as one token."""
    seg = lambda s: F.when(s.startswith(":") | (s.startswith("{") & s.endswith("}")) | (s.startswith("[") & s.endswith("]")), F.lit("<param>")).otherwise(s)
    return F.array_join(F.transform(F.split(_c(path), "/"), seg), "/")


def pascal_case(name) -> Column:
    """The first letter in upper case."""
    c = _c(name)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def operation_key(name) -> Column:
    """Without underscores and case."""
    return F.lower(F.replace(_c(name), F.lit("_"), F.lit("")))


def sdk_method(name) -> Column:
    """The HTTP method a generated function's name starts with; GET otherwise."""
    c = _c(name)
    out = F.lit(None).cast("string")
    for prefix in reversed(schema.HTTP_PREFIXES):
        hit = F.lower(c).startswith(prefix) & ((F.length(c) == len(prefix)) | F.substr(c, F.lit(len(prefix) + 1), F.lit(1)).rlike(r"^\p{Lu}"))
        out = F.when(hit, prefix.upper()).otherwise(out)
    return F.coalesce(out, F.lit("GET"))


def call_sites(body) -> Column:
    """Names of four or more letters called without a receiver."""
    return F.array_distinct(F.regexp_extract_all(_c(body), F.lit(r"(?<![\w$.:])([A-Za-z0-9_$]{4,}) *\("), F.lit(1)))


def method_call_sites(body) -> Column:
    """Names of three or more letters called on a receiver."""
    return F.array_distinct(F.regexp_extract_all(_c(body), F.lit(r"\.([A-Za-z0-9_]{3,}) *\("), F.lit(1)))


def quoted_after(body, prefix: str) -> Column:
    """P10: the first quoted literal right after the prefix."""
    import re

    return F.nullif(F.regexp_extract(_c(body), re.escape(prefix) + r"\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def all_quoted_after(body, prefix: str) -> Column:
    """Every quoted literal right after the prefix."""
    import re

    return F.regexp_extract_all(_c(body), F.lit(re.escape(prefix) + r"\s*[\"']([^\"']*)[\"']"), F.lit(1))


def branch_name(message) -> Column:
    """The branch a merge message names."""
    first = F.split_part(_c(message), F.lit("\n"), F.lit(1))
    pull = F.trim(F.regexp_extract(first, r"^Merge pull request.*? from (.*)$", 1))
    branch = F.regexp_extract(first, r"^Merge branch '([^']*)'", 1)
    return F.coalesce(F.nullif(pull, F.lit("")), F.nullif(branch, F.lit("")))


def outcome_tags(message) -> Column:
    """Distinct trimmed names in [outcome:X] tags."""
    tags = F.transform(F.regexp_extract_all(_c(message), F.lit(r"\[outcome:([^\]]*)\]"), F.lit(1)), lambda t: F.trim(t))
    return F.array_distinct(F.filter(tags, lambda t: t != ""))
