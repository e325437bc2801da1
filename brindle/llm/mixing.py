"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources a document belongs to.
A flow routes each pattern's words to the quotas of its sources; a pattern may be used up
to ``repeats`` times, each further use costing more (a convex cost), so that repetition
is spread as thinly as quotas allow.  A pattern's words are then turned into documents:
whole uses for all of them, and for the rest the documents first in a seeded order.

The seeded order is cut by two levels of hash buckets whose sums are small; only the one
bucket in which the cut falls is looked at document by document: around the cut the subset
(repeats included) is taken whose sum comes closest.  Sizes are whole numbers of words, and
documents are taken whole.  What reaches the driver is one row for each pattern.

Null and empty texts have size 0 and take nothing.  Null sources are one source, ordered
last.  Rows that repeat an id and size stand or fall together; ties in the seeded order go by id
and size.  Very long texts count whole.  Columns of any name go along; source_size, target and taken are
replaced.  An empty table gives an empty mix.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._session import cut, id_type, ship

#: Documents that a bucket should hold, and buckets of a level at most.
BUCKET, BUCKETS = 256, 1024
#: Patterns up to which their table is broadcast.
BROADCAST_PATTERNS = 100_000


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[int] = (1, 2, 3), most: int = 3, total: int | None = None) -> dict[str | None, Fraction]:
    """Shares of ``total`` by weight; sources by code point, null last, take the weights in
    turn.  None exceeds ``most`` times its size: the excess is shared again by weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_ = Fraction(sum(sizes.values()) if total is None else total), dict(weight)
    out: dict[str | None, Fraction] = {}
    while open_:
        each = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * each > most * sizes[s]]
        if not full:
            return out | {s: w * each for s, w in open_.items()}
        for s in full:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
            del open_[s]
    return out


def flow(patterns: dict[tuple, int], quotas: dict[str | None, int], repeats: int = 3) -> dict[tuple, dict[str | None, int]]:
    """Words of each pattern for each of its sources.  Use r of a pattern costs r - 1 a word;
    quotas are met as far as capacity allows, at the least cost (successive shortest paths)."""
    out: dict[tuple, dict[str | None, int]] = {p: {} for p in patterns}
    # residual graph: 0 start, 1 end, then patterns and sources
    nodes = {("p", p): 2 + i for i, p in enumerate(patterns)}
    nodes |= {("s", s): 2 + len(nodes) + i for i, s in enumerate(quotas)}
    head: list[list[int]] = [[] for _ in range(2 + len(nodes))]
    to, room, cost = [], [], []

    def edge(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            head[x].append(len(to))
            to.append(y), room.append(c), cost.append(w)
        return len(to) - 2

    routes = {}
    for (kind, x), i in nodes.items():
        if kind == "p":
            for r in range(repeats):
                edge(0, i, patterns[x], r)
            for s in x:
                routes[x, s] = edge(i, nodes["s", s], repeats * patterns[x], 0)
        else:
            edge(i, 1, quotas[x], 0)
    height = [0] * len(head)
    while True:
        best, via = [None] * len(head), [-1] * len(head)
        best[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if a == 1:  # what is further than the end is as good as at its distance
                break
            if d > best[a]:
                continue
            for e in head[a]:
                if room[e] and (best[b := to[e]] is None or d + cost[e] + height[a] - height[b] < best[b]):
                    best[b], via[b] = d + cost[e] + height[a] - height[b], e
                    heapq.heappush(heap, (best[b], b))
        if best[1] is None:
            break
        height = [h + (best[1] if d is None or d > best[1] else d) for h, d in zip(height, best, strict=True)]
        at, most = 1, None
        while at:
            most = room[via[at]] if most is None else min(most, room[via[at]])
            at = to[via[at] ^ 1]
        at = 1
        while at:
            room[via[at]] -= most
            room[via[at] ^ 1] += most
            at = to[via[at] ^ 1]
    for (p, s), e in routes.items():
        out[p][s] = out[p].get(s, 0) + room[e ^ 1]
    return out


#: Documents before and after the cut among which the sum closest to what is needed is looked
#: for, and bits that a set of sums may have (larger sums are taken in larger units).
BEFORE, AFTER, BITS = 12, 24, 1 << 22


def closest(sizes: Sequence[int], need: int, uses: int) -> list[int]:
    """How often to use each of ``sizes``, ``uses`` times at most, so that their sum comes closest to
    ``need``; further uses only where they bring it closer."""
    if not uses or not sizes:
        return [0] * len(sizes)
    unit = max(1, 2 * need >> BITS.bit_length() - 1)
    small, aim = [max(1, round(x / unit)) for x in sizes], round(need / unit)
    every = (1 << 2 * aim + 1) - 1  # a greater sum is further off than none
    reach = [1]
    items = [(i, x) for _ in range(uses) for i, x in enumerate(small)]
    for _, x in items:
        reach.append(reach[-1] | reach[-1] << x & every)
    total = 0
    for upto in (len(small), len(items)):
        sums = reach[upto]
        low = (sums & (1 << aim + 1) - 1).bit_length() - 1
        high = sums >> aim
        up = (high & -high).bit_length() - 1 if high else aim + 1
        best = low if aim - low <= up else aim + up
        if upto == len(small) or abs(best - aim) < abs(total - aim):
            total, last = best, upto
    out = [0] * len(sizes)
    for k in range(last, 0, -1):
        if not reach[k - 1] >> total & 1:
            i, x = items[k - 1]
            out[i] += 1
            total -= x
    return out


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, the documents that fill ``_need`` words: in seeded order up to the cut, and
    around it those whose sum comes closest, up to ``_uses`` times each."""
    group = group.sort_values(["_u", "_id", "_size"], kind="stable")
    group = group[group["_sum"] > 0]
    if not len(group):
        return group.assign(_times=0)[["_pattern", "_id", "_u", "_size", "_times"]]
    need, sums = int(group["_need"].iloc[0]), group["_sum"].cumsum()
    fit = int((sums <= need).sum())
    first = max(0, fit - BEFORE)
    left = need - (int(sums.iloc[first - 1]) if first else 0)
    times = [1] * first + closest([int(x) for x in group["_sum"].iloc[first : fit + AFTER]], left, int(group["_uses"].iloc[0]))
    group = group.iloc[: len(times)].assign(_times=times)
    return group[group["_times"] > 0][["_pattern", "_id", "_u", "_size", "_times"]]


def mix(docs: DataFrame, memberships: Column, size: Column, id_col: str = "doc_id", weights: Sequence[int] = (1, 2, 3), repeats: int = 3, seed: int = 17) -> DataFrame:
    """``docs`` with source_size and target, in place of columns so called (of the first source a document belongs to, in
    order) and taken, the words that the mix takes of it: a multiple of its size.

    ``memberships`` is an array of sources, ``size`` a number of words.  ``docs`` is read
    three times, so cut it first if it is expensive.
    """
    key = F.to_json(F.array_sort(F.array_distinct(memberships)), {"ignoreNullFields": "false"})
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) / float(1 << 53)
    # the rows go along as one struct, so that no name of theirs meets one of ours
    marked = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.array_sort(F.array_distinct(memberships)).alias("_sources"), key.alias("_pattern"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), u.alias("_u"))
    rows = marked.groupBy("_pattern", "_sources").agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    words = {tuple(r["_sources"]): r["words"] for r in rows}
    sizes: dict[str | None, int] = defaultdict(int)
    for p, w in words.items():
        for s in p:
            sizes[s] += w
    aim = targets(dict(sizes), weights, repeats, sum(words.values()))
    routed = flow(words, {s: round(t) for s, t in aim.items()}, repeats)
    plan = []
    for r in rows:
        p = tuple(r["_sources"])
        whole, rest = divmod(sum(routed[p].values()), r["words"]) if r["words"] else (0, 0)
        first = min(p, key=lambda s: (s is None, s or "")) if p else None
        one = min(BUCKETS, max(1, r["n"] // BUCKET))
        two = min(BUCKETS, max(1, r["n"] // one // BUCKET))
        plan.append((r["_pattern"], sizes[first] if p else 0, float(aim[first]) if p else 0.0, whole, rest, repeats - whole, one, two))
    spark = docs.sparkSession
    ship(spark)
    table = spark.createDataFrame(plan, "_pattern string, source_size long, target double, _whole long, _rest long, _uses long, _one long, _two long")
    few = len(plan) <= BROADCAST_PATTERNS
    small = lambda df: F.broadcast(df) if few else df
    at = F.floor(F.col("_u") * F.col("_one"))
    within = F.floor((F.col("_u") * F.col("_one") - at) * F.col("_two"))
    placed = marked.join(small(table), "_pattern").withColumns({"_b1": at, "_b2": within})

    order = Window.partitionBy("_pattern").orderBy("_b1", "_b2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    coarse = placed.groupBy("_pattern", "_b1", "_rest").agg(F.sum("_size").alias("_sum"))
    coarse = coarse.withColumn("_upto", F.sum("_sum").over(Window.partitionBy("_pattern").orderBy("_b1").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut1 = coarse.filter("_upto - _sum <= _rest AND _rest < _upto").groupBy("_pattern").agg(F.min(F.struct("_b1", F.expr("_rest - (_upto - _sum)").alias("left"))).alias("c")).select("_pattern", F.col("c._b1").alias("_b1"), F.col("c.left").alias("_left"))
    fine = placed.join(small(cut1), ["_pattern", "_b1"]).groupBy("_pattern", "_b1", "_b2", "_left").agg(F.sum("_size").alias("_sum"))
    fine = fine.withColumn("_upto", F.sum("_sum").over(order))
    cut2 = fine.filter("_upto - _sum <= _left AND _left < _upto").groupBy("_pattern").agg(F.min(F.struct("_b1", "_b2", F.expr("_left - (_upto - _sum)").alias("need"))).alias("c"))
    edge = cut(cut2.select("_pattern", F.col("c._b1").alias("_e1"), F.col("c._b2").alias("_e2"), F.col("c.need").alias("_need")))
    brink = placed.join(small(edge), "_pattern").filter("_b1 = _e1 AND _b2 = _e2").groupBy("_pattern", "_id", "_u", "_size", "_need", "_uses").agg(F.sum("_size").alias("_sum"))
    chosen = cut(brink.groupBy("_pattern").applyInPandas(_fill, f"_pattern string, _id {id_type(docs, id_col)}, _u double, _size long, _times long"))
    chosen = chosen.select(F.col("_pattern").alias("_cp"), F.col("_id").alias("_cid"), F.col("_size").alias("_cs"), "_times")
    # a few documents for each pattern, so counted on their own
    near = F.broadcast(chosen) if chosen.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS else chosen

    placed = placed.join(small(edge), "_pattern", "left")
    placed = placed.join(near, (F.col("_pattern") == F.col("_cp")) & F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_size") == F.col("_cs")), "left")
    before = F.coalesce(F.struct("_b1", "_b2") < F.struct("_e1", "_e2"), F.lit(False))
    once = F.when(before, 1).otherwise(F.coalesce("_times", F.lit(0)))
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("source_size", "target", "taken")]
    return placed.select(*own, "source_size", "target", (F.col("_size") * (F.col("_whole") + once)).alias("taken"))


def repeat_taken(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as many times as its sources' targets take it."""
    # the rows as one struct: their names may be any
    sized = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("words"))
    mixed = mix(sized, F.array("source"), F.col("words"), "id")
    times = F.when(F.col("words") > 0, F.col("taken") / F.col("words")).otherwise(0).cast("int")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("use")).select("row.*")
