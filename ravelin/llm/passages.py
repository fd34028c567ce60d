"""Repeated passages: MinHash banding of content-defined paragraphs, exact verification, components."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import Scratch, WordHashes, boxed, chunks, map_texts, mix64, released, shingles, sieve, slots
from .graph import components

SHINGLE, SIMILARITY, MIN_WORDS = 5, 0.8, 50
#: A paragraph ends where a shingle's hash is the least within so many places to either side: about 2 * RADIUS + 1
#: words apart, at the same words wherever a passage stands. A passage of MIN_WORDS holds three whole ones or so.
RADIUS, ROWS, WHOLE, RECALL = 5, 2, 3, 0.998
#: Words that two copies may differ in at one place, and words that must agree after it.
SLIP, AGREE = 4, 6
NONE = np.iinfo(np.uint64).max


def tuned_bands(similarity: float = SIMILARITY, rows: int = ROWS, paragraphs: int = WHOLE, recall: float = RECALL) -> int:
    """The least number of bands by which one of a passage's paragraphs collides with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows) / paragraphs))


def edges(h: np.ndarray) -> np.ndarray:
    """Where paragraphs begin: at shingle hashes that are the least within RADIUS places (the first of equal ones)."""
    out = np.ones(len(h), bool)
    for s in range(1, RADIUS + 1):
        out[s:] &= h[s:] < h[:-s]
        out[:-s] &= h[:-s] <= h[s:]
    return out


def borders(words: np.ndarray, whole: int = 400) -> np.ndarray:
    """Where the paragraphs of a text begin, and its end; none inside for a short text, which always travels whole."""
    inner = np.flatnonzero(edges(shingles(words, SHINGLE))) if len(words) > whole else []
    return np.concatenate([[0], inner, [len(words)]]).astype(int)


def stretches(cut: np.ndarray, i: np.ndarray, beyond: int) -> list[tuple[int, int, int, int]]:
    """(first, end, from, to): the parts of a text around seeds that travel to another text; i[from:to] are a part's seeds.

    ``i`` rises. ``beyond`` paragraphs to either side of the seeds are kept. A passage that goes on beyond its part is looked at
    again in the next round, with a longer part.
    """
    k = np.searchsorted(cut, i, "right") - 1
    first, end = cut[np.maximum(0, k - beyond)], cut[np.minimum(len(cut) - 1, k + 1 + beyond)]
    at = [0, *(np.flatnonzero(first[1:] > end[:-1]) + 1).tolist(), len(i)]
    return [(int(first[x]), int(end[y - 1]), x, y) for x, y in zip(at[:-1], at[1:], strict=True)]


def paragraphs(texts: list[str], words: WordHashes, bands: int, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, keys x bands) of the paragraphs of texts with min_words words or more."""
    parts, owner, n = [], [], []
    gap = np.zeros(RADIUS + SHINGLE, np.uint64)
    for i, t in enumerate(texts):
        w = t.lower().split()
        if len(w) >= min_words:
            parts += [words.of(w), gap]
            owner.append(i)
            n.append(len(w))
    if not owner:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, bands), np.int64)
    size = np.asarray(n)
    start = np.cumsum(size + len(gap)) - size - len(gap)
    h = shingles(np.concatenate(parts), SHINGLE)
    place = np.arange(len(h)) - np.repeat(start, size + len(gap))[: len(h)]
    inside = place <= np.repeat(size, size + len(gap))[: len(h)] - SHINGLE
    h = np.where(inside, h, NONE)
    edge = inside & edges(h)
    edge[start] = True
    at = np.flatnonzero(edge)
    keys = np.empty((len(at), bands), np.int64)
    for b in range(bands):
        key = np.full(len(at), np.uint64(b + 1))
        for r in range(ROWS):
            m = np.where(inside, mix64(h ^ np.uint64(0x9E3779B97F4A7C15 * (b * ROWS + r + 1) % 2**64)), NONE)
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(m, at))
        keys[:, b] = key.astype(np.int64)
    doc = np.searchsorted(start, at, "right") - 1
    return np.asarray(owner)[doc], place[at], keys


def run_length(a: np.ndarray, b: np.ndarray) -> int:
    """Leading places in which the arrays agree."""
    n, at = min(len(a), len(b)), 0
    while at < n:
        to = min(n, at + 256)
        off = np.flatnonzero(a[at:to] != b[at:to])
        if len(off):
            return at + int(off[0])
        at = to
    return n


STEPS = sorted(((i, j) for i in range(SLIP + 1) for j in range(SLIP + 1) if i or j), key=lambda x: (max(x), x))


def slip(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    """The least words to leave out at the start of either array so that the next AGREE words agree; None if too many."""
    a, b = a[: SLIP + AGREE].tolist(), b[: SLIP + AGREE].tolist()
    n, m = len(a) - AGREE, len(b) - AGREE
    for i, j in STEPS:
        if i <= n and j <= m and a[i] == b[j] and a[i : i + AGREE] == b[j : j + AGREE]:
            return i, j
    return None


def reach(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of the runs in which the arrays agree from their start, over places where they differ in a few words."""
    i = j = 0
    runs = []
    while True:
        n = run_length(a[i:], b[j:])
        runs.append((i, j, n))
        i, j = i + n, j + n
        step = slip(a[i:], b[j:])
        if step is None:
            return runs
        i, j = i + step[0], j + step[1]


def aligned(a: np.ndarray, b: np.ndarray, i: int, j: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of the equal runs around a seed, to both sides, in order; none if nothing there is equal."""
    right = [(i + x, j + y, n) for x, y, n in reach(a[i:], b[j:])]
    left = [(i - x - n, j - y - n, n) for x, y, n in reach(a[:i][::-1], b[:j][::-1])][::-1]
    (x, y, n), (_, _, m) = left[-1], right[0]
    return [r for r in (*left[:-1], (x, y, n + m), *right[1:]) if r[2]]


def windows(runs: list[tuple[int, int, int]], similarity: float):
    """(p, q), longest first for each p: windows of runs whose Jaccard, by words in equal runs, has the similarity or more."""
    # shared (1 + t) >= t (size of a's part + size of b's part), in shingles: a sum over runs, so a difference of prefix sums
    i, j, n = np.array(runs).T
    less = SHINGLE - 1
    shared = np.concatenate([[0], np.cumsum(np.maximum(0, n - less))])
    for p in range(len(runs)):
        size = np.maximum(1, i[p:] + n[p:] - i[p] - less) + np.maximum(1, j[p:] + n[p:] - j[p] - less)
        for q in np.flatnonzero((shared[p + 1 :] - shared[p]) * (1 + similarity) >= similarity * size - 1e-9)[::-1]:
            yield p, p + int(q)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, y = np.unique(shingles(a, SHINGLE)), np.unique(shingles(b, SHINGLE))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


@dataclass
class Found:
    """What the comparison of a part of a text with another text gives; places count words."""

    spans: list = field(default_factory=list)  # (first, end, first there, end there): repeated passages
    seen: list = field(default_factory=list)  # the same of all stretches that were looked at
    places: list = field(default_factory=list)  # (place, place there, side, open, words that others must share beyond): where the two part
    onward: list = field(default_factory=list)  # (place, place there): where they still agree at the part's end


def common_spans(a: np.ndarray, b: np.ndarray, seeds, min_words: int, similarity: float, starts: bool = True, ends: bool = True) -> Found:
    """The passages of a and b around seeds (pairs of places), of min_words words and the similarity or more.

    starts and ends tell whether a begins and ends where its text does.
    """
    found, out = Found(), []
    tried: list[tuple[int, int, int]] = []  # (first, end, distance) of what was too short or too different
    parting: dict[tuple[int, int, int], int] = {}
    for i, j in sorted(seeds):
        if any(s <= i < e for s, e, _, _ in out) or any(s <= i < e and d == j - i for s, e, d in tried):
            continue
        runs = aligned(a, b, i, j)
        if not runs:
            continue
        (s, t, _), (e, u, n) = runs[0], runs[-1]
        s, e, t, u = s, e + n, t, u + n
        some: list[tuple[int, int, int, int]] = []
        found.seen.append((s, e, t, u))
        if min(e - s, u - t) >= min_words and jaccard(a[s:e], b[t:u]) >= similarity:
            some.append((s, e, t, u))
        else:
            tried.append((s, e, j - i))
            done = -1  # the last run of the sub-spans that were found; a later one must go beyond
            for p, q in windows(runs, similarity) if min(e - s, u - t) >= min_words else ():
                if q <= done:
                    continue
                (x, y, _), (v, w, n) = runs[p], runs[q]
                if min(v + n - x, w + n - y) >= min_words and jaccard(a[x : v + n], b[y : w + n]) >= similarity:
                    some.append((x, v + n, y, w + n))
                    done = q
        out += some
        if s == 0 and t and not starts:
            found.onward.append((s, t))
        if e == len(a) and u < len(b) and not ends:
            found.onward.append((e - 1, u - 1))
        # a passage that goes beyond a short stretch has half of the words that the stretch lacks on one of its sides
        lacking = min_words - min(e - s, u - t)
        least = DEPTH if some or lacking < 1 else 1 if lacking <= 2 else 2 if lacking <= 6 else DEPTH
        for x, y, n in runs:
            for place in ((x, y, 0), (x + n, y + n, 1)):
                parting[place] = min(least, parting.get(place, DEPTH))
    found.spans = out
    found.places = [(at, there, side, not any(p < at < q for p, q, _, _ in out), least) for (at, there, side), least in sorted(parting.items())]
    return found


#: Words beyond a place that two texts must share to meet there.
DEPTH = 4


def marks(a: np.ndarray, places: list, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, open) of the words next to where a parts from the text ``other``.

    Texts that repeat a passage that the other holds in part only leave it at the same place of it, with the same words; so they
    have a key in common.
    """
    keys, at_, loose_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    if places:
        at, there, side, loose, least = (np.asarray(x) for x in zip(*places, strict=True))
        for depth in (1, 2, DEPTH) if least.min() < DEPTH else (DEPTH,):
            x = np.where(side == 1, at, at - depth)
            ok = np.flatnonzero((least <= depth) & (x >= 0) & (x + depth <= len(a)))
            if len(ok):
                x = x[ok]
                key = ((there[ok] * 2 + side[ok]) * 8 + depth).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) ^ np.uint64(other % 2**64)
                for k in range(depth):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + a[x + k]
                    key ^= key >> np.uint64(29)
                keys.append(mix64(key))
                at_.append(x)
                loose_.append(loose[ok])
    return np.concatenate(keys).astype(np.int64), np.concatenate(at_), np.concatenate(loose_)


def merged(spans: DataFrame, by: str, first: str, end: str) -> DataFrame:
    """(by, first, end): the unions of overlapping or touching spans of each ``by``.

    Of the spans that begin at one place only the longest counts, so no document has more rows here than words.
    """
    d = spans.groupBy(by, first).agg(F.max(end).alias(end))
    own = W.partitionBy(by).orderBy(first)
    d = d.withColumn("before", F.max(end).over(own.rowsBetween(W.unboundedPreceding, -1)))
    d = d.withColumn("run", F.sum(F.when(F.col("before") >= F.col(first), 0).otherwise(1)).over(own.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(by, "run").agg(F.min(first).alias(first), F.max(end).alias(end)).drop("run")


#: Paragraphs beside its seeds that a part of a long text takes along, in the first round; each further round takes WIDER times as many.
BEYOND, WIDER = 3, 8
#: Links of one text that a task compares with it; a text with more is sent to several.
LINKS = 2_000
#: One document in so many tells which paragraphs are frequent.
SAMPLE = 64


def frequent(rows: DataFrame, parts: int) -> tuple[np.ndarray, int]:
    """Keys of a sample of rows that hold more than a quarter of a partition's share of it (4 * parts keys at most), and the sample's size."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    hot = counts.where(F.col("n") >= max(16, total // (4 * parts) + 1)).select("key").collect()
    return np.sort(np.array([r.key for r in hot], np.int64)), total


#: Keys that a task looks at together, or so.
TOGETHER = 1 << 20


def stars(rid: np.ndarray, key: np.ndarray, at: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rid, other, at, there, key, head): links of each key's rows to its least row, and the least row of each frequent key (head)."""
    order = np.argsort(key)
    k = key[order]
    again = k[1:] == k[:-1]
    some = np.concatenate([[False], again]) | np.concatenate([again, [False]])
    if len(hot):
        some |= np.isin(k, hot)
    order = order[some]
    rid, key, at = rid[order], key[order], at[order]
    order = np.lexsort((at, rid, key))
    rid, key, at = rid[order], key[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    least = np.repeat(first, np.diff(np.append(first, len(key))))
    head = np.zeros(len(key), bool)
    head[first[np.isin(key[first], hot)]] = True
    out = head | (rid != rid[least])
    return rid[out], rid[least][out], at[out], at[least][out], key[out], head[out]


def starred(docs: DataFrame, make, hot: np.ndarray, buckets: int, scratch: Scratch) -> DataFrame:
    """(rid, other, at, there): links of each key's rows to its least row, in one exchange.

    ``make()`` gives a function of a list of texts: (text, place, keys). Keys travel packed, a row a batch and bucket. Frequent keys are dealt over all
    buckets: rows are linked to the least of their deal, and those to the least of all.
    """

    def pack(batches):
        find = make()
        for b in batches:
            rids, texts = b.column(0).to_numpy(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in chunks(texts):
                owner, at, keys = find(texts[i:j])
                key = keys.ravel()
                rid, at = (np.repeat(x, keys.shape[1]) for x in (rids[i:j][owner], at))
                spread = key.view(np.uint64)
                if len(hot):
                    spread = np.where(np.isin(key, hot), mix64(spread ^ mix64(rid.view(np.uint64))), spread)
                bucket = (spread % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
                ends = np.append(first, len(bucket))
                packed = (
                    pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
                    for x in (rid[order], key[order], at[order].astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *packed], names=["bucket", "rid", "key", "at"])

    def link(batches):
        def flush():
            rid, key, at = (np.frombuffer(b"".join(x), t) for x, t in zip(held, (np.int64, np.int64, np.int32), strict=True))
            *columns, head = stars(rid, key, at, hot)
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(head)], names=["rid", "other", "at", "there", "key", "head"])

        now, held = None, ([], [], [])
        for b in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    if now is not None:
                        yield flush()
                    now, held = bucket, ([], [], [])
                for x, y in zip(held, row, strict=True):
                    x.append(y)
        if now is not None:
            yield flush()

    packed = docs.select("rid", "text").mapInArrow(released(pack), "bucket int, rid binary, key binary, at binary")
    packed = packed.repartition("bucket").sortWithinPartitions("bucket")
    rows = scratch.keep(packed.mapInArrow(released(link), "rid long, other long, at int, there int, key long, head boolean"))
    heads = rows.where("head").select("key", "rid", "at")
    least = heads.groupBy("key").agg(F.min(F.struct("rid", "at")).alias("least"))
    onward = heads.join(least, "key").where(F.col("rid") != F.col("least.rid")).select("rid", F.col("least.rid").alias("other"), "at", F.col("least.at").alias("there"))
    return rows.where("not head").select("rid", "other", "at", "there").unionByName(onward)


def folded(docs: DataFrame, scratch: Scratch, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(rid, text) of one row of each text, and the spans (rid, other, s, e, t, u) of all others, which are whole texts.

    Texts are equal by two 64-bit hashes; the row with the least rid stands for them. Texts are only shuffled where the sieve
    can't tell that they stay: rows that repeat a rid, and few others.
    """
    docs = docs.where("text is not null").select("rid", "text")
    ids = scratch.keep(docs.select("rid", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")))
    many = scratch.keep(ids.groupBy("h", "g").agg(F.min("rid").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    members = sieve(many.select("h"))(ids, "h", "_may").where("_may").join(many, ["h", "g"])
    members = scratch.keep(members.groupBy("rid", "root").agg(F.count(F.lit(1)).alias("n")))
    copies = members.where("rid != root").select("rid", "root")
    marked = sieve(members.where("rid != root or n > 1").select("rid"))
    stay = scratch.keep(marked(ids.select("rid"), "rid", "_may").where("_may").select("rid").distinct().join(copies, "rid", "left_anti"))
    flagged = marked(docs, "rid", "_may")
    few = sieve(stay)(flagged.where("_may").select("rid", "text"), "rid", "_stays").where("_stays").select("rid", "text")
    few = few.join(stay, "rid", "left_semi").dropDuplicates(["rid"])

    def counting():
        return lambda texts: (None, [pa.array([len(t.split()) for t in texts], pa.int32())])

    roots = sieve(copies.select("root"))(docs, "rid", "_may").where("_may")
    sizes = map_texts(roots, ["rid"], counting, "n int").select(F.col("rid").alias("root"), "n").where(F.col("n") >= min_words).distinct()
    zero = F.lit(0)
    spans = copies.join(sizes, "root").select("rid", F.col("root").alias("other"), zero.alias("s"), F.col("n").alias("e"), zero.alias("t"), F.col("n").alias("u"))
    return flagged.where("not _may").select("rid", "text").unionByName(few), scratch.keep(spans)


def met(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """(rid, other, at, there): links of the rows (rid, key, at, open) of each key to its least row.

    Only rows whose place is open, and in none of the spans (rid, s, e) that go anyway, are linked.
    """
    x, y = rows.where("open").alias("x"), gone.alias("y")
    rest = x.join(y, F.expr("x.rid = y.rid and x.at >= y.s and x.at < y.e"), "left_anti").select("rid", "key", "at")
    least = rows.groupBy("key").agg(F.min(F.struct("rid", "at")).alias("least"), F.max("rid").alias("most")).where(F.col("most") != F.col("least.rid")).select("key", "least")
    return rest.join(least, "key").where(F.col("rid") != F.col("least.rid")).select("rid", F.col("least.rid").alias("other"), "at", F.col("least.at").alias("there"))


def columns_of(rows: list, kinds: list) -> list:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]


KINDS = [pa.int8(), *[pa.int64()] * 2, *[pa.int32()] * 4]
SPAN, MARK, ONWARD, SEEN = 0, 1, 2, 3


def compared(pairs: DataFrame, texts: DataFrame, beyond: int, min_words: int, similarity: float) -> DataFrame:
    """Rows (kind, rid, other, s, e, t, u, key) of the comparisons of pairs (rid, other, seeds).

    kind SPAN: a passage [s, e) of rid that is [t, u) of other. MARK: rid parts from other near word s; e is 1 where no passage
    covers the place. ONWARD: the two still agree at words s and t, where the part that was compared ends. SEEN: a stretch
    that was looked at, passage or not.
    The parts of a text around its seeds go to the other text; a text goes once to each task that needs it.
    """
    deals = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / LINKS).cast("int").alias("deals"))
    mine = pairs.join(deals, "other").withColumn("deal", F.pmod("rid", F.col("deals")).cast("int"))
    mine = mine.groupBy("rid").agg(F.collect_list(F.struct("other", "deal", "seeds")).alias("to"))

    def cut(batches):
        words = WordHashes()
        for b in batches:
            out, flat, sizes = [], [], [0]
            to, texts_ = b.column(1), b.column(2)
            ranges = to.offsets.to_pylist()
            others, dealt, seeds = (to.values.field(x) for x in ("other", "deal", "seeds"))
            others, dealt, places = others.to_pylist(), dealt.to_pylist(), seeds.offsets.to_pylist()
            at, there = (seeds.values.field(x).to_numpy() for x in ("at", "there"))
            for row, rid in enumerate(b.column(0).to_pylist()):
                w = words.of(texts_[row].as_py().lower().split())
                border = borders(w)
                for k in range(ranges[row], ranges[row + 1]):
                    i, j = at[places[k] : places[k + 1]], there[places[k] : places[k + 1]]
                    order = np.lexsort((j, i))
                    i, j = i[order], j[order]
                    for first, end, x, y in stretches(border, i, beyond):
                        out.append((others[k], dealt[k], 1, rid, first, end == len(w), w[first:end].astype("<u8").tobytes()))
                        flat.append(np.stack([i[x:y], j[x:y]], axis=1).ravel())
                        sizes.append(sizes[-1] + 2 * (y - x))
            arrays = columns_of(out, [pa.int64(), pa.int32(), pa.int8(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*arrays, lists], names=["other", "deal", "kind", "rid", "first", "ends", "words", "seeds"])

    kinds = "other long, deal int, kind byte, rid long, first int, ends boolean, words binary, seeds array<int>"
    parts = mine.join(texts, "rid").select("rid", "to", "text").mapInArrow(released(cut), kinds).withColumn("text", F.lit(None).cast("string"))
    whole = texts.join(deals, F.col("rid") == F.col("other")).select("other", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "text")
    names = parts.columns
    whole = whole.select(*(F.col(c) if c in whole.columns else F.lit(0 if c == "kind" else None).cast(parts.schema[c].dataType).alias(c) for c in names))
    dealt = parts.unionByName(whole).repartition("other", "deal").sortWithinPartitions("other", "deal", "kind")

    def verify(batches):
        words, theirs = WordHashes(), None
        for b in batches:
            out, keys = [], []
            others, kind, rids, firsts, ends, mine = (b.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6))
            flat, ranges, texts_ = b.column(7).values.to_numpy(), b.column(7).offsets.to_pylist(), b.column(8)
            for k, other in enumerate(others):
                if not kind[k]:
                    theirs = words.of(texts_[k].as_py().lower().split())
                    continue
                first, a, some, rid = firsts[k], np.frombuffer(mine[k], "<u8"), flat[ranges[k] : ranges[k + 1]], rids[k]
                seeds = zip((some[::2] - first).tolist(), some[1::2].tolist(), strict=True)
                got = common_spans(a, theirs, seeds, min_words, similarity, first == 0, ends[k])
                out += [(SPAN, rid, other, s + first, e + first, x, y) for s, e, x, y in got.spans]
                out += [(SEEN, rid, other, s + first, e + first, x, y) for s, e, x, y in got.seen]
                out += [(ONWARD, rid, other, s + first, 0, x, 0) for s, x in got.onward]
                keys += [None] * (len(got.spans) + len(got.seen) + len(got.onward))
                key, at, loose = marks(a, got.places, other)
                out += [(MARK, rid, other, s + first, int(e), 0, 0) for s, e in zip(at.tolist(), loose.tolist(), strict=True)]
                keys += key.tolist()
            yield pa.RecordBatch.from_arrays([*columns_of(out, KINDS), pa.array(keys, pa.int64())], names=["kind", "rid", "other", "s", "e", "t", "u", "key"])

    return dealt.mapInArrow(released(verify), "kind byte, rid long, other long, s int, e int, t int, u int, key long")


def repeated(docs: DataFrame, scratch: Scratch, *, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, bands: int | None = None) -> DataFrame:
    """(rid, s, e, root, root_s, kept): passages (word positions) of documents that repeat across documents.

    ``docs`` has rid, a hash of doc_id and text, and text. Each class of passages keeps the copy in its least (rid, s); kept is
    false for all others. Passages that occur again only in their own document stay.

    Copies of whole texts are folded first. The first round links the paragraphs of a key to the least of them. Two texts that the least doesn't link (or not as far
    as they agree) both part from it, within what they share and at the same place of it; so they meet by the words at that place in the next
    round, whose least is compared with the others in turn. Places that a passage found before covers need no further round, as
    their words go anyway. Rounds end when no two texts meet; each leaves out the text that all others were compared with.
    """
    bands = bands or tuned_bands(similarity)

    docs, copies = folded(docs, scratch, min_words)

    def make():
        words = WordHashes()
        return lambda texts: paragraphs(texts, words, bands, min_words)

    def keys():
        find = make()

        def of(texts: list[str]):
            owner, _, found = find(texts)
            return owner.repeat(bands), [pa.array(found.ravel(), pa.int64())]

        return of

    parts = slots(docs.sparkSession)
    sample = scratch.keep(map_texts(docs.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0), ["rid"], keys, "key long"))
    hot, total = frequent(sample, parts)
    links = starred(docs, make, hot, max(parts, total * SAMPLE // TOGETHER), scratch)
    texts, all_spans, seen, beyond = None, copies, None, BEYOND
    while True:
        pairs = scratch.keep(links.groupBy("rid", "other").agg(F.collect_set(F.struct("at", "there")).alias("seeds")))
        if texts is None:
            scratch.drop(sample)
            wanted = scratch.keep(pairs.select("rid").unionByName(pairs.select(F.col("other").alias("rid"))).distinct())
            texts = scratch.keep(sieve(wanted)(docs, "rid", "_may").where("_may").select("rid", "text"))
        elif not pairs.limit(1).count():
            scratch.drop(pairs)
            break
        else:  # a further round needs few of the last one's texts, and no other; the rest is neither read again nor shuffled
            few = scratch.keep(sieve(pairs.select("rid").union(pairs.select("other")))(texts, "rid", "_may").where("_may").select("rid", "text"))
            scratch.drop(texts)
            texts = few
        got = scratch.keep(compared(pairs, texts, beyond, min_words, similarity))
        scratch.drop(pairs)
        spans = got.where(F.col("kind") == SPAN).select("rid", "other", "s", "e", "t", "u")
        all_spans = all_spans.unionByName(spans)
        places = got.where(F.col("kind") == MARK).select("rid", "key", F.col("s").alias("at"), (F.col("e") == 1).alias("open"))
        onward = got.where(F.col("kind") == ONWARD).select("rid", "other", F.col("s").alias("at"), F.col("t").alias("there"))
        looked = got.where(F.col("kind") == SEEN).select("rid", "other", "s", "e", "t", "u")
        seen = looked if seen is None else seen.unionByName(looked)
        gone = scratch.keep(merged(all_spans, "rid", "s", "e"))
        links = met(places, gone).alias("x").join(seen.alias("y"), F.expr("x.rid = y.rid and x.other = y.other and x.at >= y.s and x.at < y.e and x.there >= y.t and x.there < y.u"), "left_anti")
        links = links.unionByName(onward)
        beyond = min(beyond * WIDER, 1 << 24)
    scratch.drop(texts)
    spans = scratch.keep(all_spans.distinct())
    held = scratch.keep(merged(spans.select(F.col("other").alias("rid"), "t", "u"), "rid", "t", "u"))
    node = lambda kind, a, b: F.xxhash64(F.lit(kind), a, b)
    g, k, x = gone.alias("g"), held.alias("k"), spans.alias("x")
    inside = x.join(g, (F.col("x.rid") == F.col("g.rid")) & (F.col("g.s") <= F.col("x.s")) & (F.col("x.e") <= F.col("g.e"))).join(k, (F.col("x.other") == F.col("k.rid")) & (F.col("k.t") <= F.col("x.t")) & (F.col("x.u") <= F.col("k.u")))
    edges = inside.select(node("gone", F.col("g.rid"), F.col("g.s")).alias("a"), node("held", F.col("k.rid"), F.col("k.t")).alias("b"))
    over = g.join(k, (F.col("g.rid") == F.col("k.rid")) & (F.col("g.s") < F.col("k.u")) & (F.col("k.t") < F.col("g.e"))).select(node("gone", F.col("g.rid"), F.col("g.s")).alias("a"), node("held", F.col("k.rid"), F.col("k.t")).alias("b"), F.col("k.rid").alias("rid"), F.col("k.t").alias("t"), ((F.col("g.s") <= F.col("k.t")) & (F.col("k.u") <= F.col("g.e"))).alias("whole"))
    labels = components(edges.unionByName(over.select("a", "b")), scratch)
    covered = over.where("whole").select("rid", "t").distinct()
    all_ = gone.withColumn("kept", F.lit(False)).withColumn("node", node("gone", F.col("rid"), F.col("s"))).unionByName(
        held.join(covered, ["rid", "t"], "left_anti").select("rid", F.col("t").alias("s"), F.col("u").alias("e"), F.lit(True).alias("kept"), node("held", F.col("rid"), F.col("t")).alias("node"))
    )
    all_ = scratch.keep(all_.join(labels, "node"))
    for done in (spans, gone, held):
        scratch.drop(done)
    root = all_.groupBy("label").agg(F.min(F.struct(~F.col("kept"), "rid", "s")).alias("root"), F.count(F.lit(1)).alias("class_size"))
    return all_.join(root, "label").select("rid", "s", "e", "kept", F.col("root.rid").alias("root"), F.col("root.s").alias("root_s"), "class_size")


def passages(docs: DataFrame, **options) -> DataFrame:
    """doc_id, passage, start, length, n_words, class_id, class_start, class_size, kept: the repeated passages.

    start and length count words (runs without white space); class_id and class_start name the copy that stands for
    the class. Documents without a passage of ``min_words`` words that repeats in another document have no row. Null and
    empty texts have none; rows equal in id and text are one document; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    d = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    found = scratch.keep(repeated(d, scratch, **options))
    ids = d.select("doc_id", "rid").distinct()
    n = F.row_number().over(W.partitionBy("rid").orderBy("s", "e"))
    out = found.withColumn("passage", n - 1).join(ids, "rid").join(ids.select(F.col("rid").alias("root"), F.col("doc_id").alias("class_id")), "root")
    return out.select("doc_id", "passage", F.col("s").cast("long").alias("start"), (F.col("e") - F.col("s")).cast("long").alias("length"), "class_id", F.col("root_s").cast("long").alias("class_start"), "class_size", "kept")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents without the passages that another document keeps; n_chars, where there is one, is counted anew.

    Only words of such passages go (with the white space after them). A text of which nothing is left stays, empty; all
    other texts are untouched, nulls and empty ones too. Rows equal in id and text are one document and lose the same. Of copies the
    one in the least document (by a hash) stays whole. All columns stay, whatever their names; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    d = boxed(docs, text=F.col("text"), rid=F.xxhash64("doc_id", "text"))
    found = repeated(d, scratch, **options).where(~F.col("kept"))
    cuts = scratch.keep(found.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("cuts")))
    d = sieve(cuts.select("rid"))(d, "rid", "_may")
    whole = d.where(~F.col("_may")).select("row")
    some = d.where("_may").join(cuts, "rid", "left")
    same = some.where("cuts is null").select("row")

    def run(batches):
        for b in batches:
            texts, marked = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, cut in enumerate(marked):
                at = [m.start() for m in re.finditer(r"\S+", texts[i])] + [len(texts[i])]
                pieces, last = [], 0
                for x in cut:
                    pieces.append(texts[i][last : at[x["s"]]])
                    last = at[x["e"]]
                texts[i] = "".join([*pieces, texts[i][last:]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    some = some.where("cuts is not null").select("row", "text", "cuts")
    out = some.mapInArrow(released(run), T.StructType([some.schema["row"], some.schema["text"]]))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(same).unionByName(out.select(row.alias("row"))).select("row.*")
