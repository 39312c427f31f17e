"""Processing only new or changed records: a work-item ledger with leases.

The ledger is a log of entries in a shared folder. An entry gets its number in
one step and only when it is complete, so of two writers of the same number one
loses and reads again, and a writer that dies at any point leaves nothing that
others see; the item lists are Parquet beside the log. The number of a lease is
its fencing token. An item is *pending* until a lease holds it, *leased* until
the lease ends, runs out (then it is pending again) or is completed, and *done*
after that. A writer whose lease has been superseded is rejected on completion.
Results are named by the items alone: the first finished attempt takes the
name, and a retry finds it. Old entries are folded into a snapshot of the log.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import Folder, Stored, bounded_join, content_hash, instant_ms, store

#: Entries behind the last snapshot of the log from which ``compact`` writes another.
COMPACT = 64


class StaleToken(RuntimeError):
    """The lease has run out and its items belong to another writer, or are done."""


class WorkLedger:
    """Work items with pending, leased and done states in a shared folder.

    Items are rows with a unique ``item_id``; any other columns are payload.
    Null item ids raise no error and are ignored. Enqueuing an id that is known
    changes nothing. The driver holds the log behind its last snapshot, never items.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    def _log(self) -> list[dict]:
        """The entries from the last snapshot on, in order. Numbers have no gaps."""
        while True:
            marks = self.folder.names("snapshots")
            first = marks[-1] if marks else ""
            out = []
            for name in (n for n in self.folder.names("log") if n >= first):
                entry = self.folder.read(f"log/{name}")
                if entry is None:  # folded into a newer snapshot in between
                    break
                out.append(entry | {"n": int(name)})
            else:
                out = out[max((k for k, e in enumerate(out) if e["op"] == "snapshot"), default=0) :]
                if not out or out[0]["op"] == "snapshot" or out[0]["n"] == 0:
                    return out

    def _commit(self, log: list[dict], entry: dict) -> int | None:
        """The entry's number; None if another writer has taken it."""
        number = log[-1]["n"] + 1 if log else 0
        return number if self.folder.create(f"log/{number:012d}", entry) else None

    def _read(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*paths) if paths else None

    @staticmethod
    def _paths(entries: list[dict]) -> list[str]:
        return [p for e in entries for p in e["data"]]

    def _known(self, log: list[dict]) -> DataFrame | None:
        return self._read(self._paths([e for e in log if e["op"] in ("enqueue", "snapshot")]))

    def _new_data(self) -> str:
        return f"{self.path}/items/{uuid.uuid4().hex}"

    def enqueue(self, items: DataFrame) -> None:
        """Add the items that the ledger doesn't know."""
        while True:
            log = self._log()
            new = items.where(F.col("item_id").isNotNull()).dropDuplicates(["item_id"])
            if (known := self._known(log)) is not None:
                new = new.join(known.select("item_id"), "item_id", "left_anti").select(*known.columns)
            data = self._new_data()
            new.write.parquet(data)
            if known is not None and self.spark.read.schema(known.schema).parquet(data).isEmpty():
                self.folder.drop(data)
                return
            if self._commit(log, {"op": "enqueue", "data": [data]}) is not None:
                return
            self.folder.drop(data)

    def _parts(self, log: list[dict], now: float) -> tuple[list[dict], list[dict], list[dict]]:
        """Leases that are done, held, and run out without having been superseded."""
        before = log[0] if log and log[0]["op"] == "snapshot" else {"leases": [], "done": []}
        ended = {e["token"]: e["op"] for e in log if e["op"] in ("done", "release")}
        until = {e["token"]: e["until"] for e in log if e["op"] == "renew"}
        taken = [*before["leases"], *(e for e in log if e["op"] == "lease")]
        gone = {t for e in taken for t in e["supersedes"]}
        leases = [e | {"until": until.get(e["n"], e["until"])} for e in taken if e["n"] not in gone]
        done = [{"data": before["done"]}] if before["done"] else []
        done += [e for e in leases if ended.get(e["n"]) == "done"]
        held = [e for e in leases if e["n"] not in ended and e["until"] > now]
        lapsed = [e for e in leases if e["n"] not in ended and e["until"] <= now]
        return done, held, lapsed

    def states(self, now: float | None = None) -> DataFrame:
        """item_id and state: pending, leased or done."""
        now, log = time.time() if now is None else now, self._log()
        done, held, _ = self._parts(log, now)
        known = self._known(log)
        if known is None:
            return self.spark.createDataFrame([], "item_id string, state string")
        out = known.select("item_id")
        marks = [self._read(self._paths(part)).select("item_id", F.lit(s).alias("state")) for part, s in ((done, "done"), (held, "leased")) if part]
        for k, m in enumerate(marks):
            out = out.join(m.withColumnRenamed("state", f"s{k}"), "item_id", "left")
        return out.select("item_id", F.coalesce(*[F.col(f"s{k}") for k in range(len(marks))], F.lit("pending")).alias("state"))

    def lease(self, owner: str, seconds: float, now: float | None = None, where=None) -> tuple[int, DataFrame] | None:
        """Take the pending items (of those that meet ``where``): the token and the items; None if there are none."""
        while True:
            at, log = time.time() if now is None else now, self._log()
            known = self._known(log)
            if known is None:
                return None
            done, held, lapsed = self._parts(log, at)
            free = known if where is None else known.where(where)
            if taken := self._paths([*done, *held]):
                free = free.join(self._read(taken).select("item_id"), "item_id", "left_anti")
            data = self._new_data()
            free.write.parquet(data)
            items = self.spark.read.schema(known.schema).parquet(data)
            work, count = items.agg(F.hex(F.coalesce(F.bit_xor(F.xxhash64("item_id")), F.lit(0))), F.count("*")).first()
            if not count:
                self.folder.drop(data)
                return None
            # a lapsed lease whose items are not all taken again is superseded as well: what is left of it is pending
            entry = {"op": "lease", "owner": owner, "until": at + seconds, "data": [data], "work": f"{work}-{count}", "supersedes": [e["n"] for e in lapsed]}
            if (token := self._commit(log, entry)) is not None:
                return token, items
            self.folder.drop(data)

    def _holds(self, log: list[dict], token: int, now: float) -> dict:
        """The lease of a token. Raises StaleToken if it has been superseded or has ended."""
        _, held, lapsed = self._parts(log, now)
        for e in [*held, *lapsed]:
            if e["n"] == token:
                return e
        raise StaleToken(f"lease {token} no longer holds its items")

    def renew(self, token: int, seconds: float, now: float | None = None) -> None:
        """Let a lease run ``seconds`` from now. Raises StaleToken if it has been superseded or has ended."""
        while True:
            log, at = self._log(), time.time() if now is None else now
            self._holds(log, token, at)
            if self._commit(log, {"op": "renew", "token": token, "until": at + seconds}) is not None:
                return

    def write(self, token: int, result: DataFrame) -> str:
        """Write a lease's result under the name of its items; the folder of the first attempt that finished."""
        log = self._log()
        leases = [*(log[0]["leases"] if log and log[0]["op"] == "snapshot" else []), *log]
        work = next((e["work"] for e in leases if e["n"] == token and "work" in e), None)
        if work is None:
            raise StaleToken(f"lease {token} has ended")
        name, attempt = f"out/{work}", f"{self.path}/attempts/{work}-{token}"
        if (first := self.folder.read(name)) is None:
            result.write.mode("overwrite").parquet(attempt)
            if self.folder.create(name, {"data": attempt}):
                return attempt
            first = self.folder.read(name)
        return first["data"]

    def complete(self, token: int, out: str, now: float | None = None) -> int:
        """Mark a lease's items as done; the entry's number. Raises StaleToken if the lease has been superseded or ended."""
        while True:
            log, at = self._log(), time.time() if now is None else now
            self._holds(log, token, at)
            if (number := self._commit(log, {"op": "done", "token": token, "out": out})) is not None:
                return number

    def release(self, token: int) -> None:
        """Give a lease's items back: they are pending. A lease that has ended stays as it is."""
        while True:
            log = self._log()
            _, held, lapsed = self._parts(log, 0.0)
            if token not in {e["n"] for e in [*held, *lapsed]}:
                return
            if self._commit(log, {"op": "release", "token": token}) is not None:
                return

    def results(self, schema, after: int = -1) -> DataFrame:
        """The results of all done leases, or of those completed by later entries than ``after``."""
        log, paths = self._log(), set()
        for e in log:
            if e["op"] == "done" and e["n"] > after:
                paths.add(e["out"])
            elif e["op"] == "snapshot":
                paths |= {out for n, out in e["outs"] if n > after}
        return self.spark.read.schema(schema).parquet(*sorted(paths)) if paths else self.spark.createDataFrame([], schema)

    @property
    def last(self) -> int:
        """The number of the last entry; -1 if there is none."""
        log = self._log()
        return log[-1]["n"] if log else -1

    def compact(self, least: int = COMPACT) -> bool:
        """Fold the log into one entry if it has ``least`` entries: all items, done items, open leases, results' folders.

        The entry takes its number like any other, so nothing committed meanwhile is lost; entries before it
        are deleted once the mark that names it exists. A crash in between leaves the longer log, which says the same.
        """
        log = self._log()
        if len(log) < least:
            return False
        done, held, lapsed = self._parts(log, time.time())
        data = []
        for part in (self._known(log), self._read(self._paths(done))):
            if part is not None:
                data.append(self._new_data())
                part.write.parquet(data[-1])
        outs = [x for e in log if e["op"] == "snapshot" for x in e["outs"]] + [[e["n"], e["out"]] for e in log if e["op"] == "done"]
        entry = {"op": "snapshot", "data": data[:1], "done": data[1:], "leases": [*held, *lapsed], "outs": outs}
        number = self._commit(log, entry)
        if number is None:
            for path in data:
                self.folder.drop(path)
            return False
        self.folder.create(f"snapshots/{number:012d}", {})
        for name in self.folder.names("log"):
            if int(name) < number:
                self.folder.delete(f"log/{name}")
        return True


def last_succeeded(runs: DataFrame) -> DataFrame:
    """root_id, done_version: the highest version of the runs whose last entry says succeeded.

    Entries of one run are ordered by ``logged_at`` alone; at equal times a
    final state wins over "started". Entries without root, run or time don't
    count. Letter case and surrounding space of ``status`` are ignored.
    """
    status = F.lower(F.trim("status"))
    last = (
        runs.where("run_id is not null and root_id is not null and logged_at is not null")
        .groupBy("root_id", "run_id")
        .agg(F.max(F.struct("logged_at", (status != "started").alias("final"), status.alias("status"), "to_version")).alias("e"))
    )
    return last.where("e.status = 'succeeded'").groupBy("root_id").agg(F.max("e.to_version").alias("done_version"))


def edge_work(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """The work items: root_id, base_version (null if nothing was processed), new_version, item_id."""
    versions = edges.where("root_id is not null and scan_version is not null").groupBy("root_id", "scan_version").agg(F.lit(1).alias("one"))
    known = versions.join(last_succeeded(runs), "root_id", "left")
    per_root = known.groupBy("root_id").agg(
        F.max("scan_version").alias("new_version"),
        F.max(F.when(F.col("scan_version") <= F.col("done_version"), F.col("scan_version"))).alias("base_version"),
    )
    todo = per_root.where("base_version is null or base_version < new_version")
    return todo.withColumn("item_id", F.concat_ws("|", "root_id", F.coalesce(F.col("base_version").cast("string"), F.lit("none")), "new_version"))


def changed_since(edges: DataFrame, items: Stored) -> DataFrame:
    """edge_id: the edges of each item's new snapshot that are new or differ from its base snapshot.

    Of several rows of an edge in a snapshot the one with the latest instant
    counts (at equal instants the one with the larger hash). Null is a value.
    Rows without id, root or version are no records. Extra columns belong to
    the content.
    """
    content = [c for c in edges.columns if c not in ("scan_version", "updated_at")]
    rows = edges.where("id is not null").withColumn("_ms", instant_ms("updated_at"))
    rows = rows.select("root_id", "id", "scan_version", "_ms", *content_hash([*content, "_ms"]))
    rows = bounded_join(rows, items, ["root_id"], spread=["id"]).where("scan_version = new_version or scan_version = base_version")
    valid = F.struct(F.coalesce("_ms", F.lit(-(2**62))).alias("ms"), "h1", "h2")
    is_new = F.col("scan_version") == F.col("new_version")
    both = rows.groupBy("root_id", "id").agg(F.max(F.when(is_new, valid)).alias("new"), F.max(F.when(~is_new, valid)).alias("old"))
    differs = F.col("old").isNull() | (F.col("old.h1") != F.col("new.h1")) | (F.col("old.h2") != F.col("new.h2"))
    return both.where(F.col("new").isNotNull() & differs).select(F.col("id").alias("edge_id")).distinct()


def process_pending(ledger: WorkLedger, edges: DataFrame, runs: DataFrame, owner: str = "driver", lease_seconds: float = 3600, only_new: bool = False) -> DataFrame:
    """Enqueue what the runs left open, take it under a lease, process it and mark it as done.

    Gives the results so far, or with ``only_new`` those of this call. A failure before the completion leaves the
    items to the next call; the result of a call that was superseded is never read.
    """
    before = ledger.last
    ledger.enqueue(edge_work(edges, runs))
    while taken := ledger.lease(owner, lease_seconds):
        token, items = taken
        part = store(items.select("root_id", "base_version", "new_version"), "items")
        out = ledger.write(token, changed_since(edges, part))
        ledger.complete(token, out)
    found = ledger.results("edge_id string", before if only_new else -1)
    ledger.compact()
    return found
