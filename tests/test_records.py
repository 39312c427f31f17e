"""The ledger, snapshot differences and orphan references against brute force and by case."""

import random

import pytest
from pyspark.sql import functions as F

from skein import session
from skein.operators.incremental import StaleToken, WorkLedger, changed_since, edge_work, last_succeeded, process_pending
from skein.operators.references import orphan_counts, orphan_references, runs_of
from skein.operators.snapshots import SnapshotIndex, changed_columns, fetch_old, hashed_rows, snapshot_changes
from skein.session import bounded_join, store

EDGE = "id string, source_id string, source_type string, target_id string, target_type string, edge_type string, edge_source string, edge_confidence string, root_id string, updated_at long, scan_version long"
RUN = "log_id long, run_id string, root_id string, to_version long, status string, logged_at timestamp, message string"


def edge(i, version, root="r", target="t", at=1_700_000_000, source=None):
    return (i, source or f"{root}:s", "function", target, None, "calls", None, "detected", root, at, version)


def items(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "item_id string")


def test_ledger_states_and_fencing(spark, tmp_path):
    ledger = WorkLedger(spark, f"file://{tmp_path}/l")
    assert ledger.lease("a", 10) is None
    ledger.enqueue(items(spark, ["x", "y", None, "x"]))
    ledger.enqueue(items(spark, ["y", "z"]))
    assert {(r[0], r[1]) for r in ledger.states().collect()} == {(i, "pending") for i in "xyz"}
    first, taken = ledger.lease("a", 10, now=100.0)
    assert taken.count() == 3 and ledger.lease("b", 10, now=105.0) is None
    assert {r[1] for r in ledger.states(now=105.0).collect()} == {"leased"}
    second, again = ledger.lease("b", 10, now=111.0)
    assert second > first and again.count() == 3
    out = ledger.write(first, items(spark, ["late"]))
    with pytest.raises(StaleToken):
        ledger.complete(first, out, now=112.0)
    # the path is that of the items: the retry finds the finished result
    assert ledger.write(second, items(spark, ["other"])) == out
    ledger.complete(second, out, now=112.0)
    assert {r[1] for r in ledger.states(now=999.0).collect()} == {"done"}
    with pytest.raises(StaleToken):
        ledger.complete(second, out)
    assert [r[0] for r in ledger.results("item_id string").collect()] == ["late"]


def test_ledger_release_and_two_writers(spark, tmp_path):
    a, b = (WorkLedger(spark, f"file://{tmp_path}/l") for _ in range(2))
    a.enqueue(items(spark, ["x"]))
    token, _ = a.lease("a", 100)
    assert b.lease("b", 100) is None
    a.release(token)
    assert b.lease("b", 100) is not None
    assert a._commit([], {"op": "enqueue", "data": ["nowhere"]}) is None


class Dying(session.Folder):
    """A folder whose writer dies before its ``left``-th step; ``after`` lets the step itself happen."""

    left, after = 10**9, False

    def _step(self, do, *args):
        self.left -= 1
        if self.left == 0 and not self.after:
            raise KeyboardInterrupt
        out = do(*args)
        if self.left == 0:
            raise KeyboardInterrupt
        return out

    def _write(self, *args):
        return self._step(super()._write, *args)

    def _publish(self, *args):
        return self._step(super()._publish, *args)

    def delete(self, *args):
        return self._step(super().delete, *args)


def test_ledger_survives_a_death_at_any_step(spark, tmp_path):
    """Whatever the step at which a writer dies, the next run finishes the work, once."""
    edges = spark.createDataFrame([edge("e1", 1), edge("e2", 1), edge("e1", 2), edge("e3", 2)], EDGE).coalesce(1)
    runs = spark.createDataFrame([], RUN)
    steps = 0
    for after in (False, True):
        for left in range(1, 100):
            path = f"file://{tmp_path}/{after}-{left}"
            first = WorkLedger(spark, path)
            first.folder = Dying(spark, path)
            first.folder.left, first.folder.after = left, after
            try:
                process_pending(first, edges, runs, lease_seconds=-1)
                break
            except KeyboardInterrupt:
                steps += 1
            got = process_pending(WorkLedger(spark, path), edges, runs)
            assert sorted(r[0] for r in got.collect()) == ["e1", "e3"], (left, after)
            assert process_pending(WorkLedger(spark, path), edges, runs, only_new=True).isEmpty()
    assert steps >= 14


def test_ledger_renewal_and_compaction(spark, tmp_path):
    ledger = WorkLedger(spark, f"file://{tmp_path}/l")
    ledger.enqueue(items(spark, ["x", "y", "z"]))
    token, _ = ledger.lease("a", 10, now=100.0, where="item_id = 'x'")
    ledger.renew(token, 50, now=105.0)
    other, _ = ledger.lease("b", 10**10, where="item_id = 'y'", now=120.0)
    ledger.complete(token, ledger.write(token, items(spark, ["done x"])), now=130.0)
    before = ledger.last
    assert not ledger.compact() and ledger.compact(least=2) and len(ledger.folder.names("log")) == 1
    assert {(r[0], r[1]) for r in ledger.states().collect()} == {("x", "done"), ("y", "leased"), ("z", "pending")}
    third, taken = ledger.lease("c", 10**9)
    assert [r[0] for r in taken.collect()] == ["z"] and third > other
    ledger.complete(other, ledger.write(other, items(spark, ["done y"])))
    assert {r[0] for r in ledger.results("item_id string").collect()} == {"done x", "done y"}
    assert [r[0] for r in ledger.results("item_id string", after=before).collect()] == ["done y"]
    with pytest.raises(StaleToken):
        ledger.write(token, items(spark, ["again"]))
    with pytest.raises(StaleToken):
        ledger.renew(other, 5)
    # a compaction that another writer overtakes leaves the log as it is
    stale = ledger._log()
    ledger.enqueue(items(spark, ["w"]))
    assert ledger._commit(stale, {"op": "snapshot", "data": [], "done": [], "leases": [], "outs": []}) is None
    assert ledger.states().count() == 4


def test_failure_neither_skips_nor_repeats(spark, tmp_path):
    """A run that fails after writing leaves its work to the next, whose result appears once."""
    edges = spark.createDataFrame([edge("e1", 1), edge("e2", 1), edge("e1", 2), edge("e3", 2)], EDGE)
    runs = spark.createDataFrame([], RUN)
    ledger = WorkLedger(spark, f"file://{tmp_path}/l")
    ledger.enqueue(edge_work(edges, runs))
    token, taken = ledger.lease("crashed", 0.0, now=0.0)
    ledger.write(token, changed_since(edges, store(taken.select("root_id", "base_version", "new_version"), "i")))
    got = process_pending(ledger, edges, runs)
    assert sorted(r[0] for r in got.collect()) == ["e1", "e3"]
    assert sorted(r[0] for r in process_pending(ledger, edges, runs).collect()) == ["e1", "e3"]


def test_last_succeeded(spark):
    rows = [
        (1, "a", "r", 3, "Succeeded", "2024-01-01 00:00:02"), (2, "a", "r", 3, "started", "2024-01-01 00:00:01"), (2, "a", "r", 3, "started", "2024-01-01 00:00:01"),
        (3, "b", "r", 9, "SUCCEEDED", "2024-01-02 00:00:01"), (4, "b", "r", 9, "rolled_back", "2024-01-02 00:00:02"), (5, "c", "q", 1, "started", "2024-01-01 00:00:00"),
        (6, None, "q", 5, "succeeded", "2024-01-01 00:00:00"), (7, "d", "q", 5, "succeeded", None),
    ]
    df = spark.createDataFrame(rows, "log_id long, run_id string, root_id string, to_version long, status string, logged_at string").withColumn("logged_at", F.to_timestamp("logged_at"))
    assert [tuple(r) for r in last_succeeded(df).collect()] == [("r", 3)]


def changed(spark, edges, runs):
    todo = store(edge_work(edges, runs).select("root_id", "base_version", "new_version"), "todo")
    return sorted(r[0] for r in changed_since(edges, todo).collect())


def test_changed_since_cases(spark):
    s = 1_700_000_000
    rows = [
        edge("same", 2), edge("same", 4), edge("ms", 2, at=s), edge("ms", 4, at=s * 1000), edge("null", 2, target=None), edge("null", 4, target=""),
        edge("stale", 2), edge("stale", 4, target="x", at=s - 5), edge("stale", 4), edge("gone", 2), edge("new", 4), edge("new", 4),
        edge("touched", 2), edge("touched", 4, at=s + 1), edge("other", 7, root="q"), edge(None, 4), edge("nowhere", None),
    ]
    edges = spark.createDataFrame(rows, EDGE).withColumn("extra", F.lit(1))
    runs = spark.createDataFrame([(1, "a", "r", 3, "succeeded", None, None)], RUN).withColumn("logged_at", F.current_timestamp())
    assert changed(spark, edges, runs) == ["new", "null", "other", "touched"]
    assert changed(spark, edges.where("false"), runs) == []


def test_changed_since_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    edges = spark.createDataFrame([edge(f"e{i}", v) for i in range(50) for v in (1, 2)] + [edge("x", 2)], EDGE)
    runs = spark.createDataFrame([(1, "a", "r", 1, "succeeded", None, None)], RUN).withColumn("logged_at", F.current_timestamp())
    assert changed(spark, edges, runs) == ["x"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_bounded_join_agrees_with_join(spark, monkeypatch, how):
    big = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(60)], "k int, v int")
    small = store(spark.createDataFrame([(0, "a"), (2, "b")], "k int, w string"), "small")
    want = sorted(map(str, big.join(small.df, "k", how).collect()))
    assert sorted(map(str, bounded_join(big, small, ["k"], how).collect())) == want
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    assert sorted(map(str, bounded_join(big, small, ["k"], how, spread=["v"]).collect())) == want


def brute_changes(rows):
    """rows: (root, id, version, at, content)."""
    snaps = {}
    for root, i, v, at, c in rows:
        cell = snaps.setdefault(root, {}).setdefault(v, {})
        if i not in cell or at > cell[i][0]:
            cell[i] = (at, c)
    out = set()
    for by in snaps.values():
        order = sorted(by)
        for a, b in zip(order, order[1:], strict=False):
            for i in by[a].keys() | by[b].keys():
                if i not in by[a]:
                    out.add((i, b, "added"))
                elif i not in by[b]:
                    out.add((i, b, "removed"))
                elif by[a][i][1] != by[b][i][1]:
                    out.add((i, b, "changed"))
    return out


@pytest.mark.parametrize("wave", [1, 2, 8])
def test_snapshot_changes_against_brute_force(spark, wave):
    r = random.Random(wave)
    rows, at = [], 0
    for root in "abc":
        for v in sorted(r.sample(range(20), r.randrange(1, 7))):
            for i in r.sample(range(12), r.randrange(0, 10)):
                for _ in range(r.randrange(1, 3)):
                    at += 1
                    rows.append((root, f"{root}{i}", v, 1_600_000_000 + r.randrange(10**6) * 100 + at % 100, r.choice([None, "", "x", "y"])))
    df = spark.createDataFrame(rows, "root_id string, id string, scan_version long, updated_at long, content string")
    got = {(x.id, x.scan_version, x.change) for x in snapshot_changes({"t": df}, wave).collect()}
    assert got == brute_changes(rows)


def test_snapshot_changes_edge_cases(spark):
    schema = "root_id string, id string, scan_version long, updated_at long, a string, b string, tbl string, gen int"
    empty = spark.createDataFrame([], schema)
    assert snapshot_changes({"t": empty}).collect() == []
    one = [("r", "x", 1, 1, None, "v", "", 0), ("r", "x", 1, 1, None, "v", "", 0)]
    assert snapshot_changes({"t": spark.createDataFrame(one, schema)}).collect() == []
    # a value that moves to another column is a change; null ids and versions are no records
    two = [*one, ("r", "x", 5, 9, "v", None, "", 0), ("r", None, 5, 9, "v", None, "", 0), (None, "z", 5, 9, "v", None, "", 0), ("r", "q", None, 9, "v", None, "", 0)]
    assert [tuple(r) for r in snapshot_changes({"t": spark.createDataFrame(two, schema)}).collect()] == [("t", "r", "x", 1, 5, "changed")]
    long = "x" * 200_000
    big = [("r", "x", 1, 1, long + "a", "", "", 0), ("r", "x", 2, 1, long + "b", "", "", 0)]
    assert [r.change for r in snapshot_changes({"t": spark.createDataFrame(big, schema)}).collect()] == ["changed"]


@pytest.mark.parametrize("wave", [1, 12])
def test_index_between_runs_gives_what_one_run_gives(spark, tmp_path, wave):
    """Snapshots delivered in several runs, some roots in each; a run again gives nothing; the index is joined without being shuffled."""
    r = random.Random(5 + wave)
    rows = [(root, f"{root}{i}", v, 100 + v, r.choice("xyz")) for root in "abc" for v in range(6) for i in range(10) if r.random() < 0.7]
    schema = "root_id string, id string, scan_version long, updated_at long, content string"
    df = spark.createDataFrame(rows, schema)
    path, got = f"file://{tmp_path}/index", set()
    for part in ("scan_version < 2", "scan_version < 4 and root_id <> 'c'", "scan_version < 4 and root_id <> 'c'", "true"):
        index = SnapshotIndex(spark, path)
        found = index.advance({"t": df.where(part)}, wave)
        index.close()
        now = [(x.id, x.scan_version, x.change) for x in found.collect()]
        assert len(now) == len(set(now)) and not got & set(now)
        got |= set(now)
    assert got == brute_changes(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("snapshot_index")]
    index = SnapshotIndex(spark, path)
    assert index.advance({"t": df}).isEmpty()
    last = {(root, i) for root, i, v, _, _ in rows if v == 5}
    assert {(x.root_id, x.id) for x in index.read().collect()} == last
    old, slots = index.read(), hashed_rows(df, "t", True).select("tbl", "root_id", "id").distinct()
    plan = old.join(slots.hint("merge"), ["tbl", "root_id", "id"], "full")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    index.close()


def test_index_survives_a_failed_run(spark, tmp_path, monkeypatch):
    rows = [("r", "a", 1, 1, "x"), ("r", "a", 2, 1, "y"), ("r", "b", 2, 1, "x")]
    df = spark.createDataFrame(rows, "root_id string, id string, scan_version long, updated_at long, content string")
    index = SnapshotIndex(spark, f"file://{tmp_path}/index")
    index.advance({"t": df.where("scan_version = 1")})
    with monkeypatch.context() as m:
        m.setattr(index.folder, "create", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.advance({"t": df})
    assert {(x.id, x.old_version, x.change) for x in SnapshotIndex(spark, index.path).advance({"t": df}).collect()} == {("a", 1, "changed"), ("b", 1, "added")}
    with pytest.raises(RuntimeError):  # a run that started before that one ended
        late = SnapshotIndex(spark, index.path)
        late._state = lambda: (0, index.folder.read("runs/000000000000"))
        late.advance({"t": df})
    index.close()


def test_old_values_of_changed_records(spark):
    rows = spark.createDataFrame([("r", "a", 1, 5, "old", None), ("r", "a", 1, 9, "newer", "k"), ("r", "a", 2, 9, "newest", "k"), ("r", "b", 1, 1, "b", None), ("r", "b", 2, 1, "b", "")], "root_id string, id string, scan_version long, updated_at long, body string, extra string")
    changes = snapshot_changes({"t": rows})
    mine = store(changes.where("change = 'changed'"), "changed")
    assert {(r.id, r.body) for r in fetch_old(mine, rows).collect()} == {("a", "newer"), ("b", "b")}
    assert {(r.id, r.body, r.extra) for r in fetch_old(mine, rows, "scan_version").collect()} == {("a", "newest", "k"), ("b", "b", "")}
    assert {(r["column"], r.records) for r in changed_columns(changes, {"t": rows}).collect()} == {("body", 1), ("extra", 1)}


def test_runs(spark):
    df = spark.createDataFrame([([1, 2, 3, 7, 9, 10],), ([],), ([4],)], "v array<long>")
    got = [[(x["start"], x["end"]) for x in r[0]] for r in df.select(runs_of(F.col("v"))).collect()]
    assert got == [[(1, 3), (7, 7), (9, 10)], [], [(4, 4)]]


@pytest.mark.parametrize("rows_bound", [0, 10**6])
def test_orphans_against_brute_force(spark, monkeypatch, rows_bound):
    monkeypatch.setattr(session, "BROADCAST_ROWS", rows_bound)
    r = random.Random(rows_bound)
    names = [f"s{i}" for i in range(8)]
    symbols = [(n, v) for n in names for v in range(6) if r.random() < 0.6] * 2
    edges, at = [], 0
    for k in range(300):
        for _ in range(r.randrange(1, 3)):
            at += 1
            edges.append(edge(f"e{k % 120}", r.randrange(6), target=r.choice([*names, "ghost", "ext", "", None]), source=r.choice([*names, "S0"]), at=10**9 + at))
    valid = {}
    for e in edges:
        if (e[0], e[10]) not in valid or valid[e[0], e[10]][9] < e[9]:
            valid[e[0], e[10]] = e
    have = set(symbols)
    want = {(i, v, end) for (i, v), e in valid.items() for end, ref in (("source", e[1]), ("target", e[3])) if ref and ref != "ext" and (ref, v) not in have}
    args = (spark.createDataFrame(edges, EDGE), spark.createDataFrame([*symbols, (None, 1)], "id string, scan_version long"), spark.createDataFrame([("ext",), (None,)], "id string"))
    found = orphan_references(*args)
    assert {(x.edge_id, x.scan_version, x.endpoint) for x in found.collect()} == want
    assert sum(x.orphans for x in orphan_counts(found).collect()) == len(want)
    assert orphan_references(args[0].where("false"), *args[1:]).collect() == []
    everything = orphan_references(args[0], args[1].where("false"), args[2].where("false")).count()
    assert everything == sum(bool(e[1]) + bool(e[3]) for e in valid.values())
