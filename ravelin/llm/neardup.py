"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification, components."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, WordHashes, boxed, map_texts, mix64, shingles, sieve
from .graph import components

SHINGLE, SIMILARITY = 5, 0.8
#: 40 bands of 8: two documents of similarity 0.8 meet in a band with probability 0.9994.
BANDS, ROWS = 40, 8
#: Widths of the first cells of the rank axis; from 1 on all cells are one wide.
CELLS = ((0.0, 0.25), (0.25, 0.25), (0.5, 0.5))
#: Bits of a rank within its unit; ranks are whole numbers of 2**-RANK_BITS.
RANK_BITS = 44


@lru_cache(None)
def poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of the Poisson distribution, as thresholds for a uniform draw."""
    n = int(mean + 12 * np.sqrt(mean) + 16)
    k = np.arange(1, n)
    return np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(mean / k))]) - mean))


def dart_minhash(elements: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS, seed: int = 0) -> np.ndarray:
    """The signature of a weighted set: two sets agree in a coordinate with the probability of their weighted Jaccard.

    elements: distinct 64-bit hashes; weights: positive (all 1 if None). Over each element lies a plane of weight and
    rank. Darts fall on it as a Poisson process of rate 1, hashed from the element and the cell of the
    plane, so equal elements get equal darts in all sets. A dart below the element's weight counts; each coordinate keeps
    the earliest rank of the darts that fall to it. Ranks are thrown up to a bound for about k ln k + 2k darts in all
    and doubled while a coordinate is empty. An empty set has a signature of zeros.
    """
    sig = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    if not len(elements):
        return np.zeros(k, np.uint64)
    # one row for each element and weight cell: [0, 1), [1, 2), [2, 4), [4, 8), ...
    if weights is None:
        base, low_w, width_w, top = elements, np.zeros(len(elements)), np.ones(len(elements)), np.ones(len(elements))
    else:
        levels = np.maximum(0, np.ceil(np.log2(np.maximum(weights, 1e-12)))).astype(int) + 1
        row = np.repeat(np.arange(len(elements)), levels)
        level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
        low_w, width_w = np.where(level == 0, 0.0, 2.0 ** (level - 1)), np.where(level == 0, 1.0, 2.0 ** (level - 1))
        base, top = mix64(elements[row] + level.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), np.asarray(weights, float)[row]
    mass = float(top.sum()) if weights is None else float(np.sum(weights))
    need = (k * np.log(k) + 2 * k) / mass
    done, bound = 0, 0.25
    while bound < need:
        bound *= 2
    start = mix64(base + np.uint64(seed) * np.uint64(0xA0761D6478BD642F) + np.uint64(1))
    while True:
        cells = [c for c in CELLS if c[0] < bound] + [(float(r), 1.0) for r in range(1, int(bound))]
        for width in (0.25, 0.5, 1.0):
            mine = [(i, lo) for i, (lo, w) in enumerate(cells) if w == width and i >= done]
            if not mine:
                continue
            number, low = np.array([i for i, _ in mine], np.uint64), np.array([lo for _, lo in mine])
            per = max(1, 200_000 // len(base))
            for at in range(0, len(mine), per):
                cell = mix64(start[:, None] + (number[at : at + per] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                u = (cell >> np.uint64(11)).astype(np.float64) * 2.0**-53
                if weights is None:
                    n = np.searchsorted(poisson_table(width), u)
                else:
                    n = np.zeros(u.shape, int)
                    for w in np.unique(width_w):
                        n[width_w == w] = np.searchsorted(poisson_table(width * w), u[width_w == w])
                r, c = np.nonzero(n)
                times = n[r, c]
                r, c = np.repeat(r, times), np.repeat(c, times)
                j = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                dart = mix64(cell[r, c] + (j.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
                rank = ((low[at + c] * 2.0**RANK_BITS).astype(np.uint64)) + ((dart >> np.uint64(20)).astype(np.float64) * width).astype(np.uint64)
                second = mix64(dart ^ np.uint64(0x8EBC6AF09C88C6E3))
                if weights is not None:
                    kept = low_w[r] + width_w[r] * ((second >> np.uint64(32)).astype(np.float64) * 2.0**-32) < top[r]
                    rank, second = rank[kept], second[kept]
                np.minimum.at(sig, (second & np.uint64(0xFFFFFFFF)) % np.uint64(k), rank)
        if sig.max() < np.iinfo(np.uint64).max:
            return sig
        done, bound = len(cells), bound * 2


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of the signature."""
    rows = sig.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(77)
    for j in range(rows.shape[1]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key


def shingle_set(text: str, words: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the runs of n words, in lower case; a shorter text is one shingle."""
    return np.unique(shingles(words.of(text.lower().split()), n))


def set_key(s: np.ndarray) -> int | None:
    """A 64-bit key of a shingle set; None for an empty one."""
    if not len(s):
        return None
    both = np.array([np.bitwise_xor.reduce(mix64(s)), s.sum(dtype=np.uint64), len(s)], np.uint64)
    return int(shingles(both, 3)[0].astype(np.int64))


def signed(docs: DataFrame, keep: list[str], bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """keep columns, ``node`` (key of the shingle set), ``n`` (its size) and ``bands`` of each text."""

    def make():
        words = WordHashes()
        cache: dict = {}

        def find(texts: list[str]):
            nodes, sizes, keys = [], [], []
            for t in texts:
                s = shingle_set(t, words)
                node = set_key(s)
                if len(cache) > 5_000:
                    cache.clear()
                if node not in cache:  # copies are common
                    cache[node] = band_keys(dart_minhash(s, None, bands * rows), bands).astype(np.int64) if node is not None else np.zeros(0, np.int64)
                nodes.append(node)
                sizes.append(len(s))
                keys.append(cache[node])
            return None, [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]

        return find

    return map_texts(docs, keep, make, "node long, n int, bands array<long>")


def shingle_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, s): the shingle sets of some nodes, read again from one document of each."""
    wanted = nodes.join(wanted, "node").select("node", F.col("first.doc_id").alias("_want"), F.col("first.thash").alias("thash"))
    wanted = scratch.keep(wanted)
    few = sieve(wanted.select("thash"))(docs.select("doc_id", "thash", "text"), "thash", "_may").where("_may")
    texts = few.join(wanted, "thash").where(F.col("doc_id").eqNullSafe(F.col("_want"))).select("node", "text")

    def make():
        words = WordHashes()
        return lambda t: (None, [pa.array([shingle_set(x, words).astype(np.int64) for x in t], pa.list_(pa.int64()))])

    return scratch.keep(map_texts(texts, ["node"], make, "s array<long>").dropDuplicates(["node"]))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with ``shared``, the exact number of shingles that both sets hold."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return both.select(*pairs.columns, F.size(F.array_intersect("sa", "sb")).alias("shared"))


def across(shared: DataFrame, pairs: DataFrame, labels: DataFrame, sets: DataFrame, enough, similarity: float) -> DataFrame:
    """(a, b, na, nb): the pairs of a bucket that may still be links once its pivot was compared with all.

    Let x be no link of the pivot's component and y of another component than x. Shingles that x and y share are of the
    pivot or not. If one is not, they meet by it. If all are, they share no more than either shares with the pivot, which
    must be enough for their sizes; so y is of one of few sizes below the pivot's. All other pairs can't be links, and
    need no comparison: a group of copies that differ from their original too much to be links doesn't give all its pairs.
    """
    open_ = shared.where("size > 2").select("key", "a", "na", F.col("node").alias("b"), F.col("n").alias("nb")).join(labels.select(F.col("node").alias("b"), "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    mixed = open_.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("pivot")).where("lo != hi")
    open_ = open_.where("a != b").join(mixed.select("key", "pivot"), "key").join(pairs.select("a", "b", "shared"), ["a", "b"])
    open_ = open_.withColumn("out", F.col("label") != F.col("pivot"))
    columns = [F.col(c) for c in ("b", "nb", "label", "shared", "out")]
    # by a shingle that the pivot lacks
    members = open_.select("a", *columns).distinct().join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    own = members.select("a", *columns, F.explode(F.array_except("sb", "sa")).alias("shingle"))
    x, y = own.where("out").alias("x"), own.alias("y")
    other = (F.col("x.label") != F.col("y.label")) & ((F.col("x.b") < F.col("y.b")) | ~F.col("y.out"))
    by_shingle = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.shingle") == F.col("y.shingle")) & other)
    # by the pivot's shingles alone: sizes from similarity * size to what the shared shingles allow
    most = F.floor(F.col("shared") * (1 + similarity) / similarity + 1e-6 - F.col("nb")).cast("int")
    sized = open_.where("out").withColumn("most", most).withColumn("least", F.ceil(F.col("nb") * similarity - 1e-6).cast("int")).where("least <= most")
    x = sized.select("key", *columns, F.explode(F.sequence("least", "most")).alias("size")).alias("x")
    y = open_.select("key", *columns).alias("y")
    by_size = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.size") == F.col("y.nb")) & other & enough(F.least("x.shared", "y.shared"), F.col("x.nb"), F.col("y.nb")))
    pick = [F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b"), F.when(F.col("x.b") < F.col("y.b"), F.col("x.nb")).otherwise(F.col("y.nb")).alias("na"), F.when(F.col("x.b") < F.col("y.b"), F.col("y.nb")).otherwise(F.col("x.nb")).alias("nb")]
    return by_shingle.select(*pick).unionByName(by_size.select(*pick)).distinct()


def classes(docs: DataFrame, *, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, thash (hash of the text), class_id, class_size, kept: one row for each document.

    class_id is the least doc_id of the documents that chains of pairs of similarity >= ``similarity`` join (Jaccard of
    the sets of five-word shingles, lower case). Equal sets are one node from the start. In each band a node
    is compared with its bucket's pivot (the node that meets most others in all bands); then, in the buckets that still hold several components, with
    those of other components that can be links at all (see ``across``), so no link of colliding documents is lost. Texts without a word, and nulls, are classes of their own. kept marks one document of
    each class (the least id; among rows equal in id and text all are marked).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("thash"))
    rows_ = scratch.keep(signed(d, ["doc_id", "thash"], bands, rows))
    nodes = rows_.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "thash")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.first("bands").alias("bands"))
    nodes = scratch.keep(nodes)
    place = nodes.select("node", "n", F.explode("bands").alias("key"))
    size = place.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # the buckets with two nodes or more: few, and what both rounds work on
    shared = scratch.keep(place.join(size, "key").select("key", "node", "n", "size"))
    # a bucket's pivot is the node that meets most others in all bands: in a group of edited copies, their original
    met = shared.groupBy("node").agg(F.sum("size").alias("met"))
    pivot = shared.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node", "n")).alias("p"))
    shared = scratch.keep(shared.join(pivot, "key").select("key", "node", "n", F.col("p.node").alias("a"), F.col("p.n").alias("na"), "size"))
    enough = lambda common, x, y: common * (1 + similarity) >= similarity * (x + y) - 1e-9
    pairs = scratch.keep(shared.where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb")).distinct())
    sets = shingle_sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), nodes, d, scratch)
    pairs = scratch.keep(compared(pairs, sets))
    links = scratch.keep(pairs.where(enough(F.col("shared"), F.col("na"), F.col("nb"))).select("a", "b"))
    labels = components(links, scratch)
    more = scratch.keep(across(shared, pairs, labels, sets, enough, similarity))
    if more.limit(1).count():
        found = compared(more, sets).where(enough(F.col("shared"), F.col("na"), F.col("nb"))).select("a", "b")
        links = scratch.keep(links.unionByName(found))
        labels = components(links, scratch)
    for done in (shared, pairs, sets, more):  # the result reads the rest
        scratch.drop(done)
    named = nodes.select("node", "first", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = named.groupBy("label").agg(F.min("first").alias("first_of"), F.sum("copies").alias("class_size"))
    named = named.join(groups, "label").select("node", "first_of", "class_size")
    out = rows_.select("doc_id", "thash", "node").join(named, "node", "left")
    lone = F.col("first_of").isNull()
    return out.select(
        "doc_id", "thash", F.when(lone, F.col("doc_id")).otherwise(F.col("first_of.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (lone | (F.col("doc_id").eqNullSafe(F.col("first_of.doc_id")) & F.col("thash").eqNullSafe(F.col("first_of.thash")))).alias("kept"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, all columns as they are, whatever their names.

    Rows equal in id and text are one document: one of them stays. Null and empty texts, and texts without a word, are
    classes of their own and stay. Of equal ids with different texts the least by the text's hash stands for the class.
    An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(classes(docs, **options))
    gone = scratch.keep(found.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("thash").alias("_t")).distinct())
    d = sieve(gone.select("_t"))(boxed(docs, doc_id=F.col("doc_id"), thash=F.xxhash64("text")), "thash", "_may")
    some = d.where("_may")
    some = some.join(gone, some["doc_id"].eqNullSafe(gone["_id"]) & (some["thash"] == gone["_t"]), "left_anti")
    d = d.where(~F.col("_may")).unionByName(some).drop("_may")
    # rows that repeat id and text: one stays. Only where there are any must texts be brought together for it.
    again = scratch.keep(found.where("class_size > 1").groupBy("doc_id", "thash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("thash"))
    if again.limit(1).count():
        d = sieve(again)(d, "thash", "_may")
        one = d.where("_may").groupBy("doc_id", "thash").agg(F.first("row").alias("row"))
        d = d.where(~F.col("_may")).select("row").unionByName(one.select("row"))
    return d.select("row.*")
