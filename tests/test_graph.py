"""Traversals and ranking on the fixture graphs and against plain Python on random ones."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from skein import schema, session
from skein.operators import graph as G
from skein.operators import ranking as R

EDGE = "id string, source_id string, target_id string, edge_type string, root_id string"
NODE = "id string, root string, file string, name string, kind string, language string, signature string, decorators string, is_test boolean, importance double, cyclomatic int, line_start int, line_end int"


def edges(spark, rows):
    return spark.createDataFrame([(f"{a}->{k}->{b}", a, b, k, "r") for a, b, k in rows], EDGE)


def calls(spark, pairs):
    return edges(spark, [(a, b, "calls") for a, b in pairs])


def node(i, kind="function", file="src/a.py", **more):
    row = {"id": i, "root": "r", "file": file, "name": i, "kind": kind, "language": "python", "signature": "", "decorators": None, "is_test": None, "importance": None, "cyclomatic": None, "line_start": 1, "line_end": 9} | more
    return tuple(row[c.split()[0]] for c in NODE.split(", "))


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODE)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def got(df, *cols):
    return {tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_neighbors_of_a_star(spark):
    e = edges(spark, [("a", "b", "calls"), ("a", "c", "defines"), ("d", "a", "calls"), ("a", "b", "references")])
    assert got(G.neighbors(e, ids(spark, "a")), "edge_type", "id") == {("calls", "b"), ("defines", "c"), ("references", "b")}
    assert got(G.neighbors(e, ids(spark, "a"), "incoming"), "id") == {"d"}
    assert got(G.neighbors(e, ids(spark, "a"), "outgoing", ["defines"]), "id") == {"c"}
    assert got(G.neighbors(e, ids(spark, "nobody")), "id") == set()
    with pytest.raises(ValueError):
        G.neighbors(e, ids(spark, "a"), kinds=["call"])
    grouped = {(r["edge_type"], tuple(r["neighbors"]), r["kind_rank"]) for r in G.grouped_neighbors(G.neighbors(e, ids(spark, "a"))).collect()}
    assert grouped == {("calls", ("b",), 1), ("defines", ("c",), 5), ("references", ("b",), 19)}


def test_reach_on_chain_and_ring(spark):
    chain = calls(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "b")])
    assert got(G.reach(chain, ids(spark, "a"), 2), "id", "hop") == {("b", 1), ("c", 2)}
    assert got(G.reach(chain, ids(spark, "d", None), 9, "incoming"), "id", "hop") == {("c", 1), ("b", 2), ("a", 3)}
    ring = calls(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert got(G.reach(ring, ids(spark, "a"), 50), "id") == {"b", "c"}
    assert G.reach(ring, ids(spark, "x"), 5).collect() == [] and G.reach(ring.where("false"), ids(spark, "a"), 5).collect() == []


def test_first_kinds_follow_the_first_step(spark):
    e = edges(spark, [("a", "b", "references"), ("b", "d", "calls"), ("a", "c", "calls"), ("c", "e", "defines"), ("c", "d", "calls")])
    found = G.reach(e, ids(spark, "a"), 3, first_kinds=True)
    assert got(found, "id", "first_kind") == {("b", "references"), ("c", "calls"), ("d", "calls"), ("e", "calls")}


def brute_reach(pairs, start, hops):
    out, near = {}, defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
    queue = deque([(start, 0)])
    seen = {start}
    while queue:
        n, h = queue.popleft()
        if h == hops:
            continue
        for m in near[n]:
            if m not in seen:
                seen.add(m)
                out[m] = h + 1
                queue.append((m, h + 1))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed, monkeypatch):
    """Reach, its reverse, components and paths against plain Python; also with joins that never broadcast."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0 if seed else 10**6)
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(14)]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(22)]
    e = calls(spark, pairs)
    reach = {(x["source"], x["id"]): x["hop"] for x in G.reach(e, ids(spark, *names[:3]), 20).collect()}
    for s in names[:3]:
        assert {i: h for (a, i), h in reach.items() if a == s} == brute_reach(pairs, s, 20)
    closure = {n: set(brute_reach(pairs, n, 99)) for n in names}
    back = got(G.reach(e, ids(spark, names[0]), 20, "incoming"), "id")
    assert back == {n for n in names if names[0] in closure[n] and n != names[0]}
    want = {}
    for n in names:
        same = {m for m in closure[n] if n in closure[m]} - {n}
        if same:
            want[n] = min(same | {n})
    assert {x["id"]: x["component"] for x in G.components(e, ["calls"]).collect()} == want
    for target in names[1:4]:
        path = G.shortest_path(e, names[0], target)
        length = brute_reach(pairs, names[0], 99).get(target)
        assert (path is None) == (length is None) and (path is None or (len(path) == length and path[-1] == target))


def test_shortest_path_cases(spark):
    e = edges(spark, [("a", "b", "calls"), ("b", "d", "calls"), ("a", "c", "calls"), ("c", "d", "calls"), ("a", "d", "defines")])
    assert G.shortest_path(e, "a", "a") == [] and G.shortest_path(e, "d", "a") is None and G.shortest_path(e, "a", "nobody") is None
    assert G.shortest_path(e, "a", "d") == ["b", "d"] and G.shortest_path(e, "a", "d", ["defines"]) == ["d"]


def test_components_ignore_loops(spark):
    e = edges(spark, [("a", "a", "calls"), ("a", "b", "calls"), ("b", "a", "depends_on"), ("b", "c", "defines"), ("c", "b", "defines")])
    assert {(r["id"], r["component"], r["size"]) for r in G.components(e).collect()} == {("a", "a", 2), ("b", "a", 2)}
    assert got(G.component_of(e, "a"), "id") == {"b"} and G.components(e.where("false")).collect() == []


def brute_pagerank(names, rows, rounds=20, d=0.85):
    out = defaultdict(list)
    for a, b, k in rows:
        out[a].append((b, schema.EDGE_WEIGHTS.get(k, 0)))
    n = len(names)
    rank = dict.fromkeys(names, 1 / n)
    for _ in range(rounds):
        new = dict.fromkeys(names, (1 - d) / n + d * sum(rank[x] for x in names if not out[x]) / n)
        for a, to in out.items():
            for b, w in to:
                new[b] += d * rank[a] * w / len(to)
        rank = new
    top = max(rank.values())
    return {k: v / top for k, v in rank.items()}


@pytest.mark.parametrize("rows", [[("a", "b", "calls")], [("a", "b", "calls"), ("b", "a", "calls")], [(f"s{i}", "hub", "calls") for i in range(6)] + [("hub", "s1", "defines"), ("hub", "s1", "calls")], [(f"c{i}", f"c{i + 1}", "implements") for i in range(12)]])
def test_pagerank(spark, rows):
    names = {x for a, b, _ in rows for x in (a, b)}
    g = G.Graph(nodes(spark, *[node(n) for n in names]), edges(spark, rows))
    rank = {r["id"]: r["importance"] for r in R.pagerank(g).collect()}
    want = brute_pagerank(sorted(names), rows)
    assert max(rank.values()) == pytest.approx(1.0) and all(rank[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_pagerank_of_nothing_and_of_isolated_nodes(spark):
    none = edges(spark, [("a", "b", "calls")]).where("false")
    assert R.pagerank(G.Graph(nodes(spark, node("x")).where("false"), none)).collect() == []
    assert {r["id"]: r["importance"] for r in R.pagerank(G.Graph(nodes(spark, node("x"), node("y")), none)).collect()} == {"x": 1.0, "y": 1.0}


def test_communities_partition_and_separate_cliques(spark):
    left = [(f"a{i}", f"a{j}") for i in range(5) for j in range(5) if i < j]
    right = [(f"b{i}", f"b{j}") for i in range(5) for j in range(5) if i < j]
    e = calls(spark, [*left, *right, ("a0", "b0"), ("a1", "t"), ("a1", "a1")])
    g = G.Graph(nodes(spark, *[node(x) for x in {y for p in [*left, *right] for y in p}], node("t", file="tests/t.py")), e)
    labels = R.communities(g)
    by = {r["id"]: r["community"] for r in labels.collect()}
    assert len(by) == 10 and "t" not in by and {by[f"a{i}"] for i in range(5)} == {"a0"} and {by[f"b{i}"] for i in range(5)} == {"b0"}
    share = {r["community"]: r["cohesion"] for r in R.cohesion(g, labels).collect()}
    assert all(0 <= v <= 1 for v in share.values()) and share["a0"] == pytest.approx(10 / 11)
    assert got(R.community_names(g.nodes, labels), "name") == {"a"}
    assert R.communities(G.Graph(g.nodes, e.where("false"))).collect() == []


def brute_communities(pairs, order, turns, gamma=0.8):
    """The moves and merges of ``communities`` in plain Python. order: id to number; turns: (sweep, id) to half."""
    near = defaultdict(dict)
    for a, b, w in pairs:
        near[order[a]][order[b]] = near[order[b]][order[a]] = w
    half = {(s, order[i]): h for (s, i), h in turns.items()}
    k = {n: round(sum(near[n].values()), 9) for n in near}
    home, twice = {n: n for n in near}, sum(k.values())
    for sweep in range(20):
        moved = False
        for h in (0, 1):
            total, size = defaultdict(float), defaultdict(int)
            for n, c in home.items():
                total[c] += k[n]
                size[c] += 1
            new = dict(home)
            for n in (n for n in near if half[sweep, n] == h):
                own, links = home[n], defaultdict(float)
                links[own] += 0.0
                for m, w in near[n].items():
                    links[home[m]] += w
                options = []
                for c, w in links.items():
                    if c != own and size[own] == 1 and size[c] == 1 and c > own:
                        continue
                    options.append((round(w - gamma * k[n] * (total[c] - (k[n] if c == own else 0)) / twice, 9), c == own, -c))
                new[n] = -max(options)[2]
                moved |= new[n] != own
            home = new
        if not moved:
            break
    bar, cap = gamma * min(12 / len(set(home.values())), 1) ** 0.5, int(0.3 * len(home))
    while True:
        size, cross = defaultdict(int), defaultdict(float)
        for c in home.values():
            size[c] += 1
        for a, b, w in pairs:
            x, y = sorted((home[order[a]], home[order[b]]))
            if x != y:
                cross[x, y] += w
        best = {}
        for (a, b), w in cross.items():
            source, target = (a, b) if size[a] < size[b] else (b, a)
            score = round(w / size[source], 9)
            if size[a] + size[b] <= cap and score >= bar:
                for c in (a, b):
                    best[c] = max(best.get(c, (-1,)), (score, -target, -source))
        proposals = {c: p for c, p in best.items() if -p[2] == c}
        if not proposals:
            break
        per = defaultdict(list)
        for c, p in proposals.items():
            if -p[1] not in proposals:
                per[-p[1]].append((p[0], -c))
        for target, asked in per.items():
            if size[target] + sum(size[-c] for _, c in asked) > cap:
                asked = [max(asked)]
            for _, c in asked:
                home = {n: target if x == -c else x for n, x in home.items()}
    back = {n: i for i, n in order.items()}
    members = defaultdict(list)
    for n, c in home.items():
        members[c].append(back[n])
    return {i: min(ms) for ms in members.values() for i in ms}


def modularity(pairs, labels):
    twice = 2 * sum(w for _, _, w in pairs)
    degree, inside = defaultdict(float), 0.0
    for a, b, w in pairs:
        degree[labels[a]] += w
        degree[labels[b]] += w
        inside += 2 * w * (labels[a] == labels[b])
    return inside / twice - sum(d * d for d in degree.values()) / twice**2


@pytest.mark.parametrize("seed", range(2))
def test_communities_against_brute_force(spark, seed):
    r = random.Random(seed)
    names = [f"g{g}n{i}" for g in range(6) for i in range(7)]
    close = [(a, b) for a in names for b in names if a < b and r.random() < (0.6 if a[:2] == b[:2] else 0.03)]
    g = G.Graph(nodes(spark, *[node(x) for x in names]), edges(spark, [(a, b, r.choice(["calls", "references"])) for a, b in close]))
    labels = {x["id"]: x["community"] for x in R.communities(g).collect()}
    pairs = [tuple(x) for x in R.coupling(g).collect()]
    ends = spark.createDataFrame([(x,) for x in labels], "id string").withColumn("h", F.xxhash64("id"))
    ranked = [x["id"] for x in ends.orderBy("h", "id").collect()]
    sweeps = ends.select("id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("s"), "h").select("s", "id", F.pmod(F.xxhash64("h", "s"), F.lit(2)))
    assert labels == brute_communities(pairs, {i: n for n, i in enumerate(ranked)}, {(x[0], x[1]): x[2] for x in sweeps.collect()})
    planted = {i: i[:2] for i in labels}
    assert modularity(pairs, labels) > 0.85 * modularity(pairs, planted)


def test_long_rings_and_chains_are_whole(spark):
    """Nothing is cut at a number of hops; components don't depend on it."""
    chain = calls(spark, [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)])
    assert G.reach(chain, ids(spark, "n000"), None).count() == 40
    ring = calls(spark, [(f"n{i:03d}", f"n{(i + 1) % 300:03d}") for i in range(300)] + [("n000", "tail"), ("x", "y"), ("y", "x")])
    sizes = G.components(ring).groupBy("component", "size").count().collect()
    assert {(r["component"], r["size"], r["count"]) for r in sizes} == {("n000", 300, 300), ("x", 2, 2)}


def test_lines_meet_spans_in_blocks(spark):
    r = random.Random(1)
    spans = [("r", "f", f"s{k}", a, a + r.choice([0, 3, 15, 16, 70, 700, 5000])) for k, a in enumerate(r.randrange(0, 6000) for _ in range(150))]
    lines = [r.randrange(0, 12000) for _ in range(150)]
    spans_df = spark.createDataFrame([*spans, ("r", "f", "back", 9, 3), ("r", "f", "none", None, 3)], "root string, file string, id string, line_start int, line_end int")
    got_ = G.containing(spark.createDataFrame([("r", "f", x) for x in set(lines)] + [("r", "f", None)], "root string, file string, line int"), spans_df)
    assert sorted((x["line"], x["id"]) for x in got_.collect()) == sorted((x, s[2]) for x in set(lines) for s in spans if s[3] <= x <= s[4])


def test_subsystems_merge_small_and_assign_tests(spark):
    clique = lambda c: [(f"{c}{i}", f"{c}{j}") for i in range(5) for j in range(5) if i < j]
    code = [f"{c}{i}" for c in "ab" for i in range(5)] + ["s1", "s2", "u1", "u2"]
    e = calls(spark, [*clique("a"), *clique("b"), ("s1", "s2"), ("s2", "b1"), ("u1", "u2"), ("a0", "b0"), ("t", "a1"), ("t", "a2"), ("b3", "t")])
    g = G.Graph(nodes(spark, *[node(x) for x in code], node("t", file="tests/t.py"), node("alone", file="tests/t.py")), e)
    labels = spark.createDataFrame([(x, {"a": "a0", "b": "b0", "s": "s1", "u": "u1"}[x[0]]) for x in code], "id string, community string")
    found = R.subsystems(g, labels)
    by = {r["id"]: r["community"] for r in found.collect()}
    assert by == {**{x: x[0] + "0" for x in code[:10]}, "s1": "b0", "s2": "b0", "u1": "u1", "u2": "u1", "t": "a0"}
    rank = spark.createDataFrame([("a0", 0.5), ("b0", 1.0)], "id string, importance double")
    assert {(r["community"], r["id"], r["score"]) for r in R.interfaces(g, found, rank).collect()} == {("a0", "a0", 0.5), ("b0", "b0", 1.0)}
    assert R.subsystems(g, labels.limit(2)).collect() == [] and R.subsystems(g, labels.withColumn("community", F.col("id"))).collect() == []
    sparse = G.Graph(nodes(spark, *[node(x) for x in code[:3]], *[node(f"z{i}") for i in range(200)]), e)
    assert R.subsystems(sparse, labels.where("id in ('a0', 'a1', 'a2')")).collect() == []


def test_risk_and_blast_radius(spark):
    rows = [node("x"), node("main"), node("handle_a"), node("hub"), node("big", importance=0.8), node("mid", importance=0.5), node("leaf"), node("used"), node("st", kind="const"), node("t", file="tests/a.py"), node("pr", kind="pr_merge")]
    pairs = [(n, "x") for n in ("main", "handle_a", "hub", "big", "mid", "leaf", "used", "st", "t", "pr")] + [(f"q{i}", "hub") for i in range(5)] + [("leaf", "used"), ("leaf", "st")]
    out = G.blast_radius(G.Graph(nodes(spark, *rows), calls(spark, pairs)), ids(spark, "x"))
    assert got(out, "id", "risk") == {("main", "critical"), ("handle_a", "critical"), ("hub", "high"), ("big", "critical"), ("mid", "high"), ("leaf", "low"), ("used", "medium"), ("st", "low"), ("t", "low")}
    assert {r["risk"]: r["n"] for r in G.risk_counts(out).collect()} == {"critical": 3, "high": 2, "medium": 1, "low": 3}


def test_short_ids_and_narrowest(spark):
    n = nodes(spark, node("r:a.py:f:function", line_start=1, line_end=20), node("q:a.py:f:function", root="q"), node("r:a.py:g:function", line_start=5, line_end=9))
    wanted = spark.createDataFrame([("a.py:f:function",), ("r:a.py:f:function",), ("a.py:g:function",), ("none",)], "wanted string")
    assert got(G.resolve_ids(wanted, n), "wanted", "id") == {("a.py:f:function", "q:a.py:f:function"), ("r:a.py:f:function", "r:a.py:f:function"), ("a.py:g:function", "r:a.py:g:function")}
    at = spark.createDataFrame([("r", "src/a.py", 7), ("r", "src/a.py", 19), ("r", "src/a.py", 99)], "root string, file string, line int")
    assert got(G.narrowest(at, n, ["function"]), "line", "id") == {(7, "r:a.py:g:function"), (19, "r:a.py:f:function")}


def test_newest_keeps_valid_rows(spark):
    rows = [("r", "a", 1, 5, "old"), ("r", "a", 2, 5, "new"), ("r", "a", 2, 1, "leftover"), ("r", "gone", 1, 1, "x"), ("q", "b", 9, None, "b"), (None, "z", 9, 1, "z")]
    df = spark.createDataFrame(rows, "root_id string, id string, scan_version long, updated_at long, body string")
    assert got(G.newest(df), "id", "body") == {("a", "new"), ("b", "b")}
