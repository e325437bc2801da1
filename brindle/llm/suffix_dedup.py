"""Removal of long strings that occur more than once, by suffix arrays.

``suffix_array`` sorts suffixes by linear grouping construction: groups of equal Lyndon
prefixes are refined in descending order through previous-smaller pointers, and each
group's order is then emitted from the sorted suffixes to its right; nothing is renamed
recursively.

A corpus has no suffix array that fits a machine, so ``dedup`` first brings equal strings
together, and losslessly so.  Of every ``length``-byte string the smallest hash of its
``GRAM``-byte strings is an anchor; equal strings have equal anchors at equal places, so
all places of a string meet in the group of one anchor.  Texts that occur in full more
than once are represented by one of them.  In a group, window hashes leave the stretches
that may repeat; equal stretches settle each other, and where stretches differ a suffix
array of them decides: starts whose neighbours in it share ``length`` bytes are repeats.
Groups of over ``HOT`` places (12 MB of stretches) are not gathered in one task: their windows are
counted as rows, by the anchor's hash and one of their own, 128 bits together; there, equal
hashes stand for equal bytes.

Null and empty texts have nothing to remove.  Texts shorter than ``length`` neither lose
nor cause anything; very long ones are taken whole, in pieces that overlap.  Repeated rows are
repeats, ids play no part in that and may be null or of any type.  Of a string that ties with others every place
is removed, the first included.  Other columns are never read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import BROADCAST_IDS, arrow, cut, free
from ._text import mix, utf8

LENGTH, GRAM = 400, 200
#: Places of an anchor up to which one task gathers them.
HOT = 20_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order."""
    n = len(text)
    # phase 1: groups by first byte, linked from high to low
    members: list[list[int]] = []
    below: list[int] = []
    above: list[int] = []
    by_byte: dict[int, int] = {}
    group = [0] * n
    for g, byte in enumerate(sorted(set(text))):
        by_byte[byte] = g
        members.append([])
        below.append(g - 1)
        above.append(g + 1)
    top = len(members) - 1
    for i, byte in enumerate(text):
        group[i] = g = by_byte[byte]
        members[g].append(i)
    done = [False] * len(members)
    previous = [-1] * n
    g = top
    while g >= 0:
        done[g] = True
        own = [i for i in members[g] if group[i] == g]
        own.sort()
        members[g] = own
        hits: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, c in hits.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            made: dict[int, int] = {}
            for p in by_count[c]:
                old = group[p]
                new = made.get(old)
                if new is None:
                    new = made[old] = len(members)
                    members.append([])
                    done.append(False)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new  # g itself at the highest, as old is below it
                members[new].append(p)
                group[p] = new
        g = below[g]
    # phase 2: place suffixes at the front of their group, from the sorted order of their right ends
    front = [0] * len(members)
    at, g = n, top
    while g >= 0:
        at -= len(members[g])
        front[g] = at
        g = below[g]
    out = [-1] * n
    placed = [False] * n
    scanned = -1
    j = n
    while True:
        s = j - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = True
            s = previous[s]
        scanned += 1
        if scanned == n:
            return out
        j = out[scanned]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit hash of each ``width`` bytes."""
    n = len(data)
    if n < width:
        return np.empty(0, np.uint64)
    spread = mix(np.arange(1, 257, dtype=np.uint64))[data]
    power, inverse = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    power[0] = inverse[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread * np.cumprod(power))))
    return mix((sums[width:] - sums[:-width]) * np.cumprod(inverse)[: n - width + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values, by block minima from either side."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the leftmost smallest gram of each ``length`` bytes."""
    places, hashes, wide = [], [], length - gram + 1
    step = 1 << 19
    for lo in range(0, max(1, len(text) - length + 1), step):
        h = rolling(np.frombuffer(text[lo : lo + step + length - 1], np.uint8), gram)
        if len(h) < wide:
            break
        low = np.uint64((1 << 20) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        at = np.unique(_sliding_min(key, wide) & low).astype(np.int64)
        places.append(at + lo)
        hashes.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def repeats(stretches: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For distinct strings, which of their starts begin ``length`` bytes that begin elsewhere too."""
    text = b"\0".join(stretches)
    begin = np.cumsum([0] + [len(s) + 1 for s in stretches])[:-1]
    valid = np.zeros(len(text) + 1, bool)
    for b, s in zip(begin, stretches, strict=True):
        valid[b : b + max(0, len(s) - length + 1)] = True
    found, last = np.zeros(len(text) + 1, bool), -1
    for i in suffix_array(text):
        if valid[i]:
            if last >= 0 and text[i : i + length] == text[last : last + length]:
                found[i] = found[last] = True
            last = i
    return [found[b : b + max(0, len(s) - length + 1)] for b, s in zip(begin, stretches, strict=True)]


def settle(groups: list[list[tuple[bytes, int, bytes]]], length: int = LENGTH) -> Iterator[tuple[bytes, int, int]]:
    """Repeated spans (text, start, end) from groups of (text, place, bytes around an anchor)."""
    for group in groups:
        # places of one text that overlap become one stretch, so that no window is there twice
        merged: list[list] = []
        for sig, lo, part in sorted(set(group)):
            if merged and merged[-1][0] == sig and lo <= merged[-1][1] + len(merged[-1][2]):
                merged[-1][2] += part[merged[-1][1] + len(merged[-1][2]) - lo :]
            else:
                merged.append([sig, lo, part])
        owners = defaultdict(list)
        for sig, lo, part in merged:
            owners[part].append((sig, lo))
        single = []
        for part, who in owners.items():
            if len(part) < length:
                continue
            if len(who) > 1:
                for sig, lo in who:
                    yield sig, lo, lo + len(part)
            single.append(part)
        # stretches that may repeat, by window hashes: a lone short one too, as places merge where a text begins or ends
        h = [rolling(np.frombuffer(p, np.uint8), length) for p in single]
        values, count = np.unique(np.concatenate(h), return_counts=True)
        often = values[count > 1]
        if not len(often):
            continue
        cores = defaultdict(list)
        for part, x in zip(single, h, strict=True):
            hit = np.flatnonzero(np.isin(x, often))
            if len(hit):
                core = part[hit[0] : hit[-1] + length]
                cores[core] += [(sig, lo + int(hit[0])) for sig, lo in owners[part]]
        names = list(cores)
        for core, who in cores.items():
            if len(who) > 1:
                for sig, lo in who:
                    yield sig, lo, lo + len(core)
        open_ = [c for c in names if len(cores[c]) == 1]
        if not open_:
            continue
        for core, mark in zip(names, repeats(names, length), strict=True):
            for sig, lo in cores[core]:
                for a, b in _runs(mark):
                    yield sig, lo + a, lo + b - 1 + length


def _runs(mark: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], mark.view(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
        for lo in range(0, len(texts), 512):
            found = [anchors(t or b"") for t in texts[lo : lo + 512]]
            sig = [s for s, (at, _) in zip(sigs[lo : lo + 512], found, strict=True) for _ in range(len(at))]
            yield pa.record_batch([pa.array(np.concatenate([h for _, h in found]).view(np.int64)), pa.array(sig, pa.binary()), pa.array(np.concatenate([at for at, _ in found]))], names=["h", "sig", "pos"])


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wide = LENGTH - GRAM
    for batch in batches:
        for sig, text, places in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            lo = [max(0, p["pos"] - wide) for p in places]
            part = [text[a : p["pos"] + LENGTH] for a, p in zip(lo, places, strict=True)]
            yield pa.record_batch([pa.array([p["h"] for p in places], pa.int64()), pa.array([p["hot"] for p in places], pa.bool_()), pa.array([sig] * len(lo), pa.binary()), pa.array(lo, pa.int64()), pa.array(part, pa.binary())], names=["h", "hot", "sig", "lo", "part"])


def _settle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h."""
    now, group = None, []

    def emit(found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        sig, a, b = zip(*found, strict=True) if found else ((), (), ())
        return pa.record_batch([pa.array(sig, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["sig", "a", "b"])

    for batch in batches:
        found = []
        for h, sig, lo, part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if h != now:
                if len(group) > 1:
                    found += settle([group])
                now, group = h, []
            group.append((sig, lo, part))
        yield emit(found)
    yield emit(list(settle([group])) if len(group) > 1 else [])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, sigs, starts, parts = (batch.column(i).to_pylist() for i in range(4))
        for k in range(0, len(h), 64):
            some = range(k, min(len(h), k + 64))
            w = [rolling(np.frombuffer(parts[i], np.uint8), LENGTH).view(np.int64) for i in some]
            n = [len(x) for x in w]
            sig = [sigs[i] for i, c in zip(some, n, strict=True) for _ in range(c)]
            at = np.concatenate([np.arange(starts[i], starts[i] + c) for i, c in zip(some, n, strict=True)])
            yield pa.record_batch([pa.array(np.repeat(np.array(h[k : k + 64], np.int64), n)), pa.array(np.concatenate(w)), pa.array(sig, pa.binary()), pa.array(at)], names=["h", "w", "sig", "a"])


def _remove_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, kept = [], [], []
        for text, found in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            out, at, n, gone = [], 0, 0, 0
            end = -1
            for s in sorted((f["a"], f["b"]) for f in found):
                if s[0] > end:
                    n += 1
                    out.append(text[at : s[0]])
                    gone += s[1] - s[0]
                elif s[1] > end:
                    gone += s[1] - end
                end = max(end, s[1])
                at = end
            out.append(text[at:])
            removed.append(gone), spans.append(n), kept.append(hashlib.sha256(b"".join(out)).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=["sig", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the bytes that
    stay) of every row of ``docs``."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = cut(docs.select(F.col(id_col).alias("id"), F.octet_length(raw).cast("long").alias("n"), F.unhex(F.md5(raw)).alias("sig"), F.sha2(raw, 256).alias("sha")))
    texts = rows.filter(F.col("n") >= LENGTH).groupBy("sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    long_docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") >= LENGTH)
    marked = long_docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("sig"), "text")
    places = cut(arrow(marked, _anchor_rows, "h long, sig binary, pos long"))
    where = F.struct("sig", "pos")
    # written, so that an anchor of very many places is a skewed key of a plain join
    shared = cut(places.groupBy("h").agg(F.min(where).alias("x"), F.max(where).alias("y"), F.count(F.lit(1)).alias("c")).filter("x <> y").select("h", (F.col("c") > HOT).alias("hot")))
    wanted = places.join(shared, "h").groupBy("sig").agg(F.collect_set(F.struct("pos", "h", "hot")).alias("places"))
    wanted = wanted.join(texts.select("sig", "rep"), "sig")
    found = wanted.join(long_docs, F.col("rep").eqNullSafe(F.col("id")) & (F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("sig")))
    # repeated ids may bring a text more than once; spans are merged in the end
    held = cut(found.select("sig", "text", "places"))
    free(places, shared)
    stretches = cut(arrow(held, _stretch_rows, "h long, hot boolean, sig binary, lo long, part binary"))
    gathered = stretches.filter("NOT hot").select("h", "sig", "lo", "part").repartition("h").sortWithinPartitions("h")
    spans = arrow(gathered, _settle_rows, "sig binary, a long, b long")
    hot = stretches.filter("hot").select("h", "sig", "lo", "part")
    if not hot.isEmpty():
        windows = arrow(hot, _window_rows, "h long, w long, sig binary, a long")
        # a place as one number, so that sums of a very frequent window are made before the shuffle
        who = F.xxhash64("sig", "a")
        twice = cut(windows.groupBy("h", "w").agg(F.min(who).alias("x"), F.max(who).alias("y")).filter("x <> y").select("h", "w"))
        # few strings repeat very often; beyond that, written as they are, a frequent one is a skewed key of a plain join
        few = twice.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        found = windows.join(F.broadcast(twice) if few else twice, ["h", "w"])
        spans = spans.union(found.select("sig", "a", (F.col("a") + LENGTH).alias("b")).distinct())
    by_text = spans.groupBy("sig").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    one = held.dropDuplicates(["sig"]).select("sig", "text")
    results = arrow(one.join(by_text, "sig").select("sig", "text", "spans"), _remove_rows, "sig binary, n_removed long, n_spans long, kept string")
    whole = F.col("copies") > 1
    out = rows.join(texts.select("sig", "copies").join(results, "sig", "left"), "sig", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
