"""Whole documents into containers of fixed capacity (problem 8).

Method: hierarchical multi-length packing. Pieces are routed to tiers of context size (tier t holds sizes above
capacity / 2^(t+1) and up to capacity / 2^t). Tier by tier, from the longest, a tier's pieces are packed into windows
among themselves, best fit decreasing; then the gaps of its windows are filled from the shorter tiers, the next one
first, with the largest piece that fits. Windows are the containers; they are dealt to step groups so that each group
holds the same mix of tiers and patterns.

Sizes are whole numbers up to the capacity, so the plan is made on the counts of sizes alone (a table of
at most ``capacity`` rows whatever the data): a list of patterns with multiplicities. Pieces are matched
to pattern places by their rank among pieces of equal size, ranked in salted blocks.

Defined results: texts without tokens are not placed; a document above the capacity is cut into full
pieces and a rest; all others stay whole; equal documents are placed as often as they are given; more than ``MAX_RUNS``
runs or none are refused; an empty table gives no containers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlattice.llm.tokens import VOCABULARY, count_tokens
from adlattice.session import cut

RANK_BLOCK = 100_000  # pieces of one size ranked in one block
MAX_RUNS = 1000
STEP = 64


@dataclass
class Pattern:
    """So many windows of a tier that all hold ``pieces``: ``(size, how many of it)``."""

    tier: int
    pieces: list[tuple[int, int]]
    times: int
    gap: int


def tier(size: int, capacity: int) -> int:
    """0 for sizes above half the capacity, 1 above a quarter, and so on."""
    return (capacity // max(1, size)).bit_length() - 1


class Stock:
    """Pieces left by size; finds the largest size left that is no larger than a gap (a union-find over the sizes used up)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for s, n in counts.items():
            self.left[s] = n
        self.below = [s if n else s - 1 for s, n in enumerate(self.left)]
        self.below[0] = 0

    def largest(self, gap: int) -> int:
        """0 if nothing fits."""
        below, x = self.below, gap
        while below[x] != x:
            below[x] = below[below[x]]
            x = below[x]
        return x

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            self.below[size] = size - 1


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up all counts, the windows of the longest tier first.

    A step takes a size into as many windows of a pattern as its count allows, and so either finishes the pattern or uses
    up the size (two steps at most); the number of steps is that of the different sizes, not of the pieces.
    """
    stock = Stock({s: n for s, n in counts.items() if n > 0}, capacity)
    out: list[Pattern] = []
    t = 0
    while capacity >> t:
        floor, top = capacity >> (t + 1), capacity >> t
        while stock.largest(top) > floor:
            out += _filled(_window(stock, t, floor, top, capacity), stock)
        t += 1
    return out


def _window(stock: Stock, t: int, floor: int, top: int, capacity: int) -> Pattern:
    """The next windows of a tier, from its own sizes only; one pattern as often as the counts allow."""
    gap, pieces, limit = capacity, [], top
    while (s := stock.largest(min(gap, limit))) > floor:
        k = min(gap // s, stock.left[s])
        pieces.append((s, k))
        gap -= s * k
        limit = s - 1
    times = min(stock.left[s] // k for s, k in pieces)
    for s, k in pieces:
        stock.take(s, k * times)
    return Pattern(t, pieces, times, gap)


def _filled(first: Pattern, stock: Stock) -> list[Pattern]:
    """The windows of a pattern with their gaps filled from shorter tiers; the pattern splits where a size runs out."""
    done, todo = [], [first]
    while todo:
        p = todo.pop()
        s = stock.largest(min(p.gap, p.pieces[-1][0] - 1)) if p.gap else 0
        if not s:
            done.append(p)
            continue
        k = min(p.gap // s, stock.left[s])
        n = min(p.times, stock.left[s] // k)
        stock.take(s, k * n)
        if n < p.times:
            todo.append(Pattern(p.tier, list(p.pieces), p.times - n, p.gap))
        todo.append(Pattern(p.tier, [*p.pieces, (s, k)], n, p.gap - s * k))
    return done


def places(patterns: list[Pattern]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Per size rows ``(first rank, first container, pieces per container)``, and ``(first container, tier)`` per pattern."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    tiers = []
    base = 0
    for p in patterns:
        tiers.append((base, p.tier))
        for s, k in p.pieces:
            rows.setdefault(s, []).append((used.get(s, 0), base, k))
            used[s] = used.get(s, 0) + k * p.times
        base += p.times
    return {s: np.array(r, dtype=np.int64) for s, r in rows.items()}, np.array([*tiers, (base, 0)], dtype=np.int64)


def pieces(counted: DataFrame, capacity: int) -> DataFrame:
    """``(doc_id, piece_no, start_token, n_tokens)``: whole documents, or full cuts and a rest."""
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.lit(capacity)).cast("int") - 1)).alias("piece_no")
    start = F.col("piece_no").cast("bigint") * F.lit(capacity)
    return counted.filter("tokens > 0").select("doc_id", "tokens", parts).select("doc_id", "piece_no", start.alias("start_token"), F.least(F.lit(capacity), F.col("tokens") - start).cast("bigint").alias("n_tokens"))


def ranked(items: DataFrame, salts: int) -> DataFrame:
    """Adds ``rank``, from 0 among pieces of equal size; blocks of a hot size are ranked apart and offset."""
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)))
    counts = salted.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece_no")).cast("bigint") - 1
    return salted.withColumn("r", inner).join(offsets, ["n_tokens", "salt"]).withColumn("rank", F.col("r") + F.col("offset")).drop("salt", "r", "offset")


def members(counted: DataFrame, run_name: str, capacity: int, step: int = STEP) -> DataFrame:
    """``(run_name, container_id, step_group, window_tier, tier, doc_id, piece_no, start_token, n_tokens)``; ``tier`` is that of
    the piece, ``window_tier`` that of the window it is in."""
    items = pieces(counted, capacity)
    # at most ``capacity`` rows
    sizes = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, tiers = places(plan(sizes, capacity))
    shared = counted.sparkSession.sparkContext.broadcast((table, tiers))
    groups = max(1, -(-int(tiers[-1, 0]) // step))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, tiers = shared.value
        for b in batches:
            size, rank = b["n_tokens"].to_numpy(), b["rank"].to_numpy()
            at = np.zeros(len(b), np.int64)
            for s in np.unique(size):
                mine = size == s
                rows = table[int(s)]
                i = np.searchsorted(rows[:, 0], rank[mine], side="right") - 1
                at[mine] = rows[i, 1] + (rank[mine] - rows[i, 0]) // rows[i, 2]
            window = tiers[np.searchsorted(tiers[:, 0], at, side="right") - 1, 1]
            out = b[["doc_id", "piece_no", "start_token", "n_tokens"]].assign(run_name=run_name, container_id=at, step_group=at % groups, window_tier=window)
            yield out.assign(tier=[tier(int(s), capacity) for s in size])

    schema = "run_name string, container_id bigint, step_group bigint, window_tier int, tier int, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint"
    salts = 1 + max(sizes.values(), default=0) // RANK_BLOCK
    return ranked(items, salts).select("doc_id", "piece_no", "start_token", "n_tokens", "rank").mapInPandas(place, schema)


def pack(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """All runs of ``limits (run_name, capacity_tokens)``, a short list."""
    runs = limits.select("run_name", "capacity_tokens").limit(MAX_RUNS + 1).collect()
    if not 0 < len(runs) <= MAX_RUNS:
        raise ValueError(f"between 1 and {MAX_RUNS} runs can be packed")
    counted = cut(count_tokens(documents, vocabulary=vocabulary))
    return reduce(DataFrame.unionByName, [members(counted, r["run_name"], r["capacity_tokens"]) for r in runs])


def containers(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per container with its pieces, tokens and unused room."""
    rows = packed.groupBy("run_name", "container_id", "step_group", "window_tier").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("used_tokens"))
    caps = F.broadcast(limits.select("run_name", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")))
    return rows.join(caps, "run_name").withColumn("unused_tokens", F.col("capacity_tokens") - F.col("used_tokens"))


def by_tier(boxes: DataFrame) -> DataFrame:
    """Per run and tier of the windows: containers, tokens and the share of their room that is unused."""
    rows = boxes.groupBy("run_name", "window_tier").agg(F.count(F.lit(1)).alias("containers"), F.sum("used_tokens").alias("used_tokens"), F.sum("unused_tokens").alias("unused_tokens"))
    return rows.withColumn("unused_share", F.round(F.col("unused_tokens") / (F.col("used_tokens") + F.col("unused_tokens")), 6))


def summary(boxes: DataFrame) -> DataFrame:
    """Per run: containers, tokens, share unused, least and most tokens of a step group."""
    groups = boxes.groupBy("run_name", "step_group").agg(F.count(F.lit(1)).alias("n"), F.sum("used_tokens").alias("used"), F.sum("unused_tokens").alias("unused"))
    return groups.groupBy("run_name").agg(F.sum("n").alias("containers"), F.sum("used").alias("used_tokens"), F.sum("unused").alias("unused_tokens"), F.min("used").alias("least_in_group"), F.max("used").alias("most_in_group"))
