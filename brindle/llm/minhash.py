"""Near-duplicate groups from bottom-k sketches of one hash function.

1. A text's distinct word shingles are hashed; texts with equal sets form a class, so
   exact copies cost no more than one of them.
2. The ``k`` smallest hashes of a class are its sketch.  Two sets as similar as asked
   share at least ``_shared`` sketch values, but for a chance below 1e-6 where sets are
   larger than k.  With values ordered from rare to frequent, the first k - shared + 1 of
   each must then meet: only those are kept as keys, and only if another class has them.
   Passages that many unrelated texts hold sort last and make no keys.
3. Each inverted list compares its members with one pivot, and groups grow by connected
   components.  A list of a thousand copies of one text costs thousands of pairs, not a
   million.
4. Classes in lists that still mix groups get finer sketches (``FINE`` values, of most texts
   the whole set) and lists of their own.  Pivots again while that shrinks lists, and at last whatever is left between
   groups is compared, but for whole sets that have too few values left after the list's own:
   at the first value that two sets share, what follows must do.  No link between groups is lost.
5. A pair passes if its union sketch allows it, and then by the full sets.

Null and empty texts and texts without words link with nothing; rows without an id link
with nothing and are kept, their component being null.  Rows that repeat an id count as
one document, which links by every text that it has.  Ids may be of any type that sorts.
Ties (equal sets) are one class.  Other columns are never read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._session import BROADCAST_IDS, arrow, by_ids, cut, free, id_type
from ._text import chunks, mix, shingle_sets, utf8

#: Values of a sketch: for the first lists, for the union sketch, and for lists that mix groups.
SKETCH, UNION, FINE = 32, 128, 1024


@lru_cache(16)
def _shared(k: int, num: int, den: int, risk: float = 1e-6) -> int:
    """Sketch values that sets of similarity num/den share, but for a chance of ``risk``."""
    t, total = num / den, 0.0
    for c in range(k + 1):
        total += comb(k, c) * t**c * (1 - t) ** (k - c)
        if total > risk:
            return max(1, c)
    return k


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, k: int) -> DataFrame:
    """id, n (set size), a and b (a 128-bit signature of the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in chunks(texts, 1 << 22):
                n, a, b, low = [], [], [], []
                for found in shingle_sets(texts[lo:hi], shingle):
                    n.append(len(found))
                    a.append(int(mix(found).sum(dtype=np.uint64)) - (1 << 63))
                    b.append(int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) - (1 << 63))
                    low.append((found[:k] >> np.uint64(1)).view(np.int64))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(low, pa.list_(pa.int64()))], names=["id", "n", "a", "b", "sketch"])

    return arrow(docs.select(id_col, text_col), run, f"id {id_type(docs, id_col)}, n long, a long, b long, sketch array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id and all shingle hashes, in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in chunks(texts, 1 << 20):
                found = [(s >> np.uint64(1)).view(np.int64) for s in shingle_sets(texts[lo:hi], shingle)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(found, pa.list_(pa.int64()))], names=["id", "set"])

    return arrow(docs.select(id_col, text_col), run, f"id {id_type(docs, id_col)}, set array<long>")


def _keys(sketched: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """v (a sketch value), rep, n and at (how many of its values are rarer) from rep, n and sketch:
    the rare values of each class that others have too."""
    shared = _shared(k, num, den)
    values = sketched.select("rep", "n", F.explode("sketch").alias("v"))
    # written, so that a value of very many classes is a skewed key of a plain join
    common = cut(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    n = F.col("n")
    fewest = F.least(F.ceil(n * num / den), F.when(n * den > k * num, F.lit(k) - F.floor(n * (den - num) / num)).otherwise(n))
    first = F.when(n <= k, n - fewest + 1).otherwise(k - shared + 1)
    own = values.join(common, "v").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    own = own.withColumn("lone", (F.least(n, F.lit(k)) - F.size("vs")).cast("int")).withColumn("left", (first - F.col("lone")).cast("int"))
    keys = own.filter("left > 0").select(F.posexplode(F.slice("vs", F.lit(1), "left")).alias("at", "x"), "rep", "n", "lone")
    out = cut(keys.select("x.v", "rep", "n", (F.col("at") + F.col("lone")).alias("at")))
    free(common)
    return out


def _fits(a: str, b: str, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _may_meet(a: str, b: str, num: int, den: int, k: int) -> Column:
    """Whether sets whose first common value is this one can still share enough, by what each
    has left; asked of whole sets only."""
    n = F.col(f"n{a}") + F.col(f"n{b}")
    whole = F.greatest(f"n{a}", f"n{b}") <= k
    return ~whole | (F.least(F.col(f"n{a}") - F.col(f"at{a}"), F.col(f"n{b}") - F.col(f"at{b}")) * (num + den) >= n * num)


def _attached(pairs: DataFrame, sets: DataFrame, of: Column) -> DataFrame:
    """``pairs`` (a, b) with ``of`` their sets as sa and sb.  Only what pairs name is moved; pairs are
    broadcast while their counted number allows it."""
    few = pairs.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    left = sets.select(F.col("id").alias("a"), of.alias("sa")).join(F.broadcast(pairs) if few else pairs, "a")
    right = by_ids(sets.select(F.col("id").alias("b"), of.alias("sb")), pairs.select("b").distinct(), "b")
    return left.join(right, "b")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are as similar as num/den, written."""
    need = _shared(UNION, num, den)
    near = _attached(pairs, sets, F.slice("set", 1, UNION))
    near = near.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, UNION))
    hits = F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb"))
    # a union of fewer values is the whole one
    near = cut(near.filter(hits * UNION >= F.size("u") * need).select("a", "b"))
    both = _attached(near, sets, F.col("set")).select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    out = cut(both.filter(F.col("i") * den >= (F.col("na") + F.col("nb") - F.col("i")) * num).select("a", "b"))
    free(near)
    return out


def _mixed(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """``keys`` of lists with members of several groups, with their ``root``, the list's main group
    ``most`` and a pivot ``p`` of that, drawn by hash; written."""
    named = keys.join(roots, keys["rep"] == roots["node"], "left").select(keys["*"], F.coalesce("root", "rep").alias("root"))
    lists = named.groupBy("v", "root").agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct("rep", "n"), F.xxhash64("rep", "v")).alias("p"))
    major = cut(lists.groupBy("v").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root", "p")).alias("major")).filter("roots > 1").select("v", F.col("major.root").alias("most"), F.col("major.p").alias("p")))
    out = cut(named.join(major, "v"))
    free(major)
    return out


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _same(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of one id's several texts; no rows where ids don't repeat."""
    some, sig = rows.filter("n > 0 AND id IS NOT NULL"), F.struct("n", "a", "b")
    several = some.groupBy("id").agg(F.min(sig).alias("x"), F.max(sig).alias("y")).filter("x <> y").select("id")
    return by_ids(some, cut(several), "id").join(named, ["n", "a", "b"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100), k: int = SKETCH) -> DataFrame:
    """n_shingles, component_id (smallest id reachable over links of ``similarity`` or more)
    and kept (the id is its component's) of every row of ``docs``."""
    num, den = similarity
    sketched = cut(sketches(docs, id_col, text_col, shingle, k))
    some = sketched.filter("n > 0 AND id IS NOT NULL")
    classes = cut(some.groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")))
    rows = cut(sketched.select("id", "n", "a", "b"))
    free(sketched)
    keys = _keys(classes, k, num, den)
    named = cut(classes.select("n", "a", "b", "rep"))
    free(classes)
    # a repeated id may bring several texts: each has its own set, and the class's is picked by its signature
    wanted = by_ids(docs.select(id_col, text_col), keys.select(F.col("rep").alias(id_col)).distinct(), id_col)
    sets = cut(full_sets(wanted, id_col, text_col, shingle))

    # written, so that a long list is a skewed key of a plain join
    pivot = cut(keys.groupBy("v").agg(F.min(F.struct("rep", "n")).alias("p")))
    pairs = keys.join(pivot, "v").filter(F.col("rep") > F.col("p.rep")).select("rep", "n", "p").filter(_fits("n", "p.n", num, den))
    tried = cut(pairs.select(F.col("rep").alias("a"), F.col("p.rep").alias("b")).distinct())
    links = _verified(tried, sets, num, den)
    roots = components(links.union(_same(rows, named)))
    free(pivot, links)
    mixed = _mixed(keys, roots)
    free(keys)
    if not mixed.isEmpty():
        some = by_ids(sets, mixed.select(F.col("rep").alias("id")).distinct(), "id")
        fine = _keys(some.select(F.col("id").alias("rep"), F.size("set").cast("long").alias("n"), F.slice("set", 1, FINE).alias("sketch")), FINE, num, den)
        free(mixed)
        mixed, known, last = _mixed(fine, roots), [tried], False
        before = mixed.count()
        while before:
            minor = mixed.filter("root <> most")
            if last:
                # all that is left between groups: the few outside the largest one against the list
                side = lambda df, x, *more: df.select("v", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}"), F.col("root").alias(f"r{x}"), *more)
                pairs = side(minor, "a").join(side(mixed, "b", "most"), "v").filter("ra <> rb AND (rb = most OR a < b)")
                pairs = pairs.filter(_fits("na", "nb", num, den)).filter(_may_meet("a", "b", num, den, FINE))
            else:
                pairs = minor.select(F.col("rep").alias("a"), F.col("p.rep").alias("b"), "n", "p").filter(_fits("n", "p.n", num, den))
            known.append(cut(_ordered(pairs).join(reduce(DataFrame.union, known), ["a", "b"], "left_anti")))
            links = _verified(known[-1], sets, num, den)
            found = not links.isEmpty()
            if found:
                old, roots = roots, components(links.union(roots.select("node", "root")))
                free(old)
            free(links)
            if last:
                break
            if found:
                free(mixed)
                mixed = _mixed(fine, roots)
            now = mixed.count()
            # pivots again only while lists shrink by a tenth
            before, last = now, 10 * now > 9 * before
        free(fine, *known)
    else:
        free(tried)
    free(mixed, sets)

    # written, so that a class of very many copies is a skewed key of a plain join
    grouped = cut(named.join(roots, named["rep"] == roots["node"], "left").select("n", "a", "b", F.coalesce("root", "rep").alias("root")))
    found = rows.join(grouped, ["n", "a", "b"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs`` with one document of each group.  Rows that repeat an id are one
    document: the one of smallest text (null first) stays, or, of equal texts, of smallest hash."""
    found = near_groups(docs, id_col, text_col, shingle, similarity).select(id_col, "kept")
    per_id = cut(found.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_rows"), F.bool_and("kept").alias("kept")))
    out = by_ids(docs, per_id.filter("NOT kept").select(id_col), id_col, "left_anti")
    again = per_id.filter("kept AND _rows > 1").select(id_col)
    if again.isEmpty():
        return out
    order = F.struct(F.col(text_col), F.xxhash64(*docs.columns))
    one = by_ids(out, again, id_col).select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), order.alias("order")).groupBy("id").agg(F.min_by("row", "order").alias("row"))
    return by_ids(out, again, id_col, "left_anti").unionByName(one.select("row.*"))
