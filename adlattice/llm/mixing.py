"""Sources mixed to target weights (problem 9).

Method: Sainte-Lague apportionment. The budget is dealt out as blocks of equal tokens: each block goes to
the source of the highest quotient share / (2 blocks + 1) that still has room under its repeat cap. The seats are
computed from the divisor, so their number does not matter. A source's blocks go to the shards in turn, which gives whole
quotas per source and shard whose sums differ by one block at most. Documents are then laid out in seeded order, pass
after pass, and the quotas of the shards cut this sequence: each use of a document belongs to one shard.

The default budget is the largest at which every source that has documents reaches its target under its
cap. Defined results: sources without target, without documents (NULL source included) or without tokens
are not used and their share is reported as 0; the shares of the others are scaled to sum 1; the last
document of a quota may exceed it by less than its own length; more than ``MAX_SOURCES`` targets are refused; an empty
table gives an empty mix.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlattice.llm.tokens import VOCABULARY, count_tokens
from adlattice.session import cut

BLOCK_TOKENS = 256
SHARDS = 8
MAX_SOURCES = 10_000
BUCKET_ROWS = 50_000  # documents of a source laid out by one task at most, on average


@dataclass(frozen=True)
class Source:
    name: str
    share: float
    repeats: int
    tokens: int


def live(sources: list[Source]) -> list[Source]:
    return [s for s in sources if s.tokens > 0 and s.share > 0 and s.repeats > 0]


def budget(sources: list[Source]) -> int:
    """The most tokens at which all targets can be met without exceeding a cap."""
    total = sum(s.share for s in live(sources))
    return int(min((s.tokens * s.repeats * total / s.share for s in live(sources)), default=0))


def seats(sources: list[Source], blocks: int, block_tokens: int) -> dict[str, int]:
    """Blocks per source by highest quotients; a source at its cap gets no more.

    A bisection finds the quotient at which almost all blocks are dealt; the auction deals the few that remain.
    """
    kept = live(sources)
    cap = {s.name: -(-s.tokens * s.repeats // block_tokens) for s in kept}
    blocks = min(blocks, sum(cap.values()))

    def dealt(quotient: float) -> dict[str, int]:
        # quotients share / (2 k + 1) above the given one
        return {s.name: min(cap[s.name], int((s.share / quotient + 1) / 2)) for s in kept}

    if not kept or blocks <= 0:
        return dict.fromkeys(cap, 0)
    low, high = min(s.share for s in kept) / (4.0 * (blocks + 4) * len(kept)), 2 * max(s.share for s in kept)
    for _ in range(200):
        middle = (low * high) ** 0.5
        low, high = (low, middle) if sum(dealt(middle).values()) <= blocks else (middle, high)
    # two less each, for safety against rounding
    won = {n: max(0, x - 2) for n, x in dealt(high).items()}
    heap = [(-s.share / (2 * won[s.name] + 1), s.name, s.share) for s in kept if won[s.name] < cap[s.name]]
    heapq.heapify(heap)
    for _ in range(blocks - sum(won.values())):
        _, n, share = heapq.heappop(heap)
        won[n] += 1
        if won[n] < cap[n]:
            heapq.heappush(heap, (-share / (2 * won[n] + 1), n, share))
    return won


def apportion(sources: list[Source], blocks: int, block_tokens: int, shards: int = SHARDS) -> dict[str, list[int]]:
    """Blocks per source and shard: each source deals its blocks in turn, where the source before it left off."""
    turn, out = 0, {}
    for n, won in seats(sources, blocks, block_tokens).items():
        each, more = divmod(won, shards)
        out[n] = [each + ((s - turn) % shards < more) for s in range(shards)]
        turn = (turn + more) % shards
    return out


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 11, vocabulary: str = VOCABULARY, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """``(chosen, shares)``: the chosen documents with their number of uses and the shard of each use, and the real shares."""
    spark = documents.sparkSession
    wanted = targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError("too many sources")
    named = documents.join(F.broadcast(targets.select("source")), "source", "left_semi")
    counted = cut(count_tokens(named, "source", vocabulary=vocabulary).filter("tokens > 0"))
    # one row a source
    have = {r["source"]: r for r in counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    sources = [Source(r["source"], r["target_share"], r["max_repeats"], have[r["source"]]["tokens"] if r["source"] in have else 0) for r in wanted]
    total = budget(sources) if total_tokens is None else min(total_tokens, budget(sources))
    quota = apportion(sources, total // block_tokens, block_tokens, shards)
    plan = []
    for s in live(sources):
        ends = [min(x * block_tokens, s.tokens * s.repeats) for x in accumulate(quota[s.name])]
        plan.append((s.name, s.tokens, s.repeats, ends[-1], ends[:-1], 1 + have[s.name]["n"] // BUCKET_ROWS))
    steps = F.broadcast(spark.createDataFrame(plan, "source string, all bigint, repeats int, need bigint, ends array<bigint>, buckets bigint"))
    placed = counted.join(steps, "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("buckets")))
    before = Window.orderBy("bucket").partitionBy("source").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("inner", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(bases, ["source", "bucket"]).withColumn("start", F.col("base") + F.col("inner"))
    # a document is used in each pass in which it begins before the quota ends
    uses = F.least(F.col("repeats"), F.greatest(F.lit(0), F.ceil((F.col("need") - F.col("start")) / F.col("all")).cast("int")))
    shard = F.transform(F.sequence(F.lit(0), F.col("uses") - 1), lambda p: F.size(F.filter(F.col("ends"), lambda e: e <= F.col("start") + p * F.col("all"))))
    chosen = laid.withColumn("uses", uses).filter("uses > 0").select("doc_id", "source", "tokens", "uses", shard.alias("shards"))
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    everything = used.agg(F.sum("tokens").alias("all_tokens")).scalar()
    shares = targets.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "most_uses")], F.round(F.coalesce(F.col("tokens") / everything, F.lit(0.0)), 6).alias("real_share")
    )
    return chosen, shares
