"""Filling containers of fixed capacity with items: vector best fit over size classes.

A container has three capacities: tokens, documents and attention cost (the
sum of squared lengths). Items of one token length are alike, so the fit is
computed over the histogram of lengths, which has at most ``capacity`` + 1 rows
however many documents there are: lengths in falling order, each placed where
the weighted norm of what would remain is least (or the weighted dot product of
demand and residual is largest) under every constraint; containers in the same
state are handled together. The plan is then a small table of slots, and every
document takes the slot of its rank among the items of its length. Ranks are
counted within hash buckets and lengths, so one frequent length is no hot group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.llm.tokens import lengths
from skein.session import bounded_join, store

#: Rows of one hash bucket in which ranks are counted.
BUCKET_ROWS = 200_000


@dataclass
class Limits:
    """Capacities of a container and the weights of their residuals."""

    tokens: int = 2048
    documents: int = 1 << 20
    cost: int = 1 << 42
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"  # or "dot"


    @property
    def longest(self) -> int:
        """The longest item that fits an empty container."""
        return min(self.tokens, math.isqrt(self.cost))


@dataclass
class _Bins:
    """Groups of containers in the same state."""

    limits: Limits
    count: list = field(default_factory=list)
    rest: list = field(default_factory=list)  # (tokens, documents, cost)
    content: list = field(default_factory=list)  # [(length, copies), ...]

    def copies(self, length: int, rest: tuple) -> int:
        """How many items of ``length`` a container with this residual still takes."""
        t, d, c = rest
        most = d
        if length:
            most = min(most, t // length, c // (length * length))
        return int(most)


class _Open:
    """Containers that still take documents, by residual tokens and then by residual documents and cost.

    A bit for each residual of tokens tells where there are any, so a search goes from one to the next without looking at the others.
    """

    def __init__(self, limits: Limits):
        self.limits, self.bits, self.at = limits, 0, {}

    def add(self, group: int, rest: tuple) -> None:
        t, d, c = rest
        if d > 0:
            self.at.setdefault(t, {}).setdefault((d, c), []).append(group)
            self.bits |= 1 << t

    def take(self, rest: tuple) -> int:
        """A group in this state, which is taken out."""
        t, d, c = rest
        states = self.at[t]
        group = states[d, c].pop()
        if not states[d, c]:
            del states[d, c]
            if not states:
                del self.at[t]
                self.bits ^= 1 << t
        return group

    def best(self, length: int) -> tuple | None:
        """The state that an item goes to: the least weighted norm of what remains, or the largest weighted dot product; None if it fits nowhere.

        Residuals of tokens are tried from the best one on, until what tokens alone say is worse than the best score so far.
        """
        lim = self.limits
        (wt, wd, wc), cost, dot = lim.weights, length * length, lim.rule == "dot"
        best, found, bits = None, None, self.bits >> length << length
        while bits:
            t = bits.bit_length() - 1 if dot else (bits & -bits).bit_length() - 1
            bits ^= 1 << t
            if dot:
                bound = -(wt * length * t / lim.tokens**2 + wd / lim.documents + wc * cost / lim.cost)
            else:
                bound = wt * ((t - length) / lim.tokens) ** 2
            if best is not None and bound >= best:
                break
            for d, c in self.at[t]:
                if c < cost:
                    continue
                if dot:
                    score = -(wt * length * t / lim.tokens**2 + wd * d / lim.documents**2 + wc * cost * c / lim.cost**2)
                else:
                    score = wt * ((t - length) / lim.tokens) ** 2 + wd * ((d - 1) / lim.documents) ** 2 + wc * ((c - cost) / lim.cost) ** 2
                if best is None or score < best:
                    best, found = score, (t, d, c)
        return found


def plan(counts: dict[int, int], limits: Limits) -> _Bins:
    """Vector best fit of ``counts`` (length to number of items), longest first."""
    bins, open_ = _Bins(limits), _Open(limits)
    for length in sorted(counts, reverse=True):
        n = int(counts[length])
        if length > limits.longest:
            raise ValueError(f"an item of {length} tokens fits no container")
        while n > 0:
            state = open_.best(length)
            if state is None:
                g, state, content, available = -1, (limits.tokens, limits.documents, limits.cost), [], n
            else:
                g = open_.take(state)
                content, available = bins.content[g], bins.count[g]
            k = bins.copies(length, state)
            take, each = (min(available, n // k), k) if n >= k else (1, n)
            if g >= 0:
                bins.count[g] -= take
                if bins.count[g]:
                    open_.add(g, state)
            after = (state[0] - each * length, state[1] - each, state[2] - each * length * length)
            bins.count.append(take)
            bins.rest.append(after)
            bins.content.append([*content, (length, each)])
            open_.add(len(bins.count) - 1, after)
            n -= take * each
    return bins


def slots(bins: _Bins) -> pd.DataFrame:
    """length, slot (first of a run), container (first), copies, start: where the items of each length go."""
    rows, taken, first = [], {}, 0
    for count, content in zip(bins.count, bins.content, strict=True):
        if not count:
            continue
        start = 0
        for length, copies in content:
            rows.append((length, taken.get(length, 0), first, copies, start))
            taken[length] = taken.get(length, 0) + count * copies
            start += length * copies
        first += count
    return pd.DataFrame(rows, columns=["length", "slot", "container", "copies", "start"])


def items(sizes: DataFrame, id_col: str, capacity: int) -> DataFrame:
    """id, part, length: each row of ``sizes`` (id, tokens), those over the capacity in full parts and a rest."""
    full = F.col("tokens") / F.lit(capacity)
    parts = F.greatest(F.ceil(full), F.lit(1)).cast("int")
    split = sizes.select(id_col, "tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return split.select(id_col, "part", F.least(F.col("tokens") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("length"))


def pack(sizes: DataFrame, id_col: str = "doc_id", limits: Limits | None = None) -> DataFrame:
    """id, part, length, container, start: where every item of ``sizes`` (id, tokens) lies.

    Items of no tokens (empty and null texts) are placed like others and take a
    document's place only. Items longer than a container takes under all its limits are split into parts of that length
    and a rest. Null ids and repeated rows are items of their own;
    a null size counts as 0. No rows give no containers.
    """
    limits = limits or Limits()
    sizes = sizes.select(id_col, F.coalesce("tokens", F.lit(0)).alias("tokens"))
    stored = store(items(sizes, id_col, limits.longest), "items")
    buckets = max(16, stored.rows // BUCKET_ROWS)
    cells = stored.df.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "part"), F.lit(buckets)).cast("int"))
    counts = store(cells.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.df.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    table = slots(plan(histogram, limits))
    by_length = {int(k): tuple(g[c].to_numpy() for c in ("slot", "container", "copies", "start")) for k, g in table.groupby("length")}
    shared = sizes.sparkSession.sparkContext.broadcast(by_length)
    offsets = counts.df.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = cells.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy(id_col, "part")) - 1)
    ranked = bounded_join(ranked, store(offsets, "offsets"), ["length", "bucket"], spread=[id_col]).select(id_col, "part", "length", (F.col("rank") + F.col("before")).alias("rank"))
    id_type = sizes.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            container = np.zeros(len(batch), dtype=np.int64)
            start = np.zeros(len(batch), dtype=np.int64)
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                slot, first, copies, offset = shared.value[int(size)]
                k = np.searchsorted(slot, rank[at], side="right") - 1
                inside = rank[at] - slot[k]
                container[at] = first[k] + inside // copies[k]
                start[at] = offset[k] + (inside % copies[k]) * size
            yield pd.DataFrame({id_col: batch[id_col], "part": batch["part"], "length": batch["length"], "container": container, "start": start})

    return ranked.mapInPandas(place, f"{id_col} {id_type}, part int, length int, container bigint, start bigint")


def pack_texts(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """``pack`` of a table of documents by the tokens of their texts."""
    return pack(lengths(docs), "doc_id", limits)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """containers, tokens, unused: how well the containers are filled."""
    per = packed.groupBy("container").agg(F.sum("length").alias("tokens"))
    return per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(1 - F.sum("tokens") / (F.count("*") * capacity), 6).alias("unused"))


def used(packed: DataFrame, limits: Limits) -> DataFrame:
    """containers, least, and the used share of each capacity, with the number of containers in which documents or cost leave no room for a token.

    ``least`` is the number that no packing can go below: the largest of the sums of tokens, documents and cost over their capacities.
    """
    per = packed.groupBy("container").agg(F.sum("length").alias("t"), F.count("*").alias("d"), F.sum(F.col("length").cast("bigint") * F.col("length")).alias("c"))
    n = F.count("*")
    least = F.greatest(*[F.ceil(F.sum(x) / F.lit(cap)) for x, cap in (("t", limits.tokens), ("d", limits.documents), ("c", limits.cost))])
    shares = [F.round(F.sum(x) / (n * cap), 4).alias(name) for x, cap, name in (("t", limits.tokens, "tokens"), ("d", limits.documents, "documents"), ("c", limits.cost, "cost"))]
    room = F.col("t") < limits.tokens
    bound = [F.count(F.when(room & (F.col("d") == limits.documents), 1)).alias("full_documents"), F.count(F.when(room & (F.col("c") + 2 * limits.longest > limits.cost), 1)).alias("full_cost")]
    return per.agg(n.alias("containers"), least.alias("least"), *shares, *bound)
