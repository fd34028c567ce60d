"""A log-bilinear language model, trained in numpy by noise-contrastive estimation, and scores of texts.

The model's own vocabulary is the most frequent words, the more the more words the corpus has, and
classes of all others by their ending. It learns from all documents that aren't held out. A word outside the vocabulary has the probability of its class times its share of the class in
the counts of the whole corpus, which a distributed pass gathers.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Scratch, bucket_of, chunks, map_texts, released

#: Words (at least) and word classes that the network tells apart; words whose counts are broadcast, at most.
WORDS, CLASSES, HEAD = 256, 64, 65_536
#: The network tells apart as many words as this power of the number of distinct words, if that is more than WORDS.
GROWTH = 0.4
#: Documents and tokens (at most) of a share. A task trains on one share; all shares together are all training documents.
TRAIN_DOCS, TRAIN_TOKENS = 4_000, 4_000_000
#: A round trains so many times the shares of all rounds before, side by side, and averages their networks.
WIDER = 3
CONTEXT, SIZE, NOISE, BATCH, EPOCHS, RATE = 4, 16, 64, 2048, 3, 0.15
END = b""
ENDING = 2


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased (bytes.lower and bytes.split know ASCII letters and white space only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Counts:
    """What scoring needs of the corpus counts besides those of rare words."""

    head: dict[bytes, int]  # word -> rank
    c: np.ndarray  # counts of the head
    total: int
    distinct: int
    ids: np.ndarray  # output of the network for each word of the head
    endings: dict[bytes, int]  # ending -> class output
    denominators: np.ndarray  # by output: N + 0.5 (V + 1) of a class; 1 for words
    sums: np.ndarray  # by output: its count

    @property
    def n_out(self) -> int:
        return len(self.denominators)

    @property
    def kind(self) -> str:
        """The type of an output's id in ``encoded``."""
        return "<i4" if self.n_out >= 1 << 15 else "<i2"

    def other(self, word: bytes) -> int:
        return self.endings.get(word[-ENDING:], self.n_out - 1)


def count_words(docs: DataFrame) -> DataFrame:
    """(token, c) over all words and ends of ``docs``; the end is the empty token."""

    def make():
        def find(texts: list[str]):
            got: Counter = Counter()
            for t in texts:
                got.update(words_of(t))
            got[END] += len(texts)
            return [], [pa.array(list(got), pa.binary()), pa.array(got.values(), pa.int64())]

        return find

    return map_texts(docs, [], make, "token binary, c long", 16_000_000).groupBy("token").agg(F.sum("c").alias("c"))


def digest(counts: DataFrame, head: int = HEAD) -> Counts:
    """The broadcast part of the counts: at most ``head`` frequent words, whatever the corpus."""
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    level = F.floor(F.log2("c") * 32)
    cut, n = None, 0
    for at, more in counts.groupBy(level.alias("at")).count().orderBy(F.desc("at")).collect():
        if n + more > head:
            break
        cut, n = at, n + more
    rows = counts.where(level >= cut).collect() if cut is not None else []
    rows = sorted(((bytes(r[0]), r[1]) for r in rows), key=lambda r: (-r[1], r[0]))
    known = {w: i for i, (w, _) in enumerate(rows)}
    most = max(WORDS, int(distinct**GROWTH))
    vocabulary = [END, *[w for w, _ in rows if w != END][: most - 1]] if END in known else [w for w, _ in rows][:most]
    chosen = {w: i for i, w in enumerate(vocabulary)}
    ends = counts.groupBy(F.substring("token", -ENDING, ENDING).alias("e")).agg(F.sum("c"), F.count(F.lit(1))).collect()
    sums = {bytes(e or b""): [c, v] for e, c, v in ends}
    for w in vocabulary:
        sums[w[-ENDING:]][0] -= rows[known[w]][1]
        sums[w[-ENDING:]][1] -= 1
    best = sorted((e for e in sums if sums[e][1] > 0), key=lambda e: (-sums[e][0], e))[: CLASSES - 1]
    endings = {e: len(vocabulary) + i for i, e in enumerate(best)}
    size = len(vocabulary) + len(best) + 1
    n_c, v_c = np.zeros(size), np.zeros(size)
    for e, (c, v) in sums.items():
        n_c[endings.get(e, size - 1)] += c
        v_c[endings.get(e, size - 1)] += v
    denominators = np.where(np.arange(size) < len(vocabulary), 1.0, n_c + 0.5 * (v_c + 1))
    ids = np.array([chosen.get(w, endings.get(w[-ENDING:], size - 1)) for w, _ in rows], np.int32)
    n_c[: len(vocabulary)] = [rows[known[w]][1] for w in vocabulary]
    return Counts(known, np.array([c for _, c in rows], np.int64), int(total or 0), int(distinct), ids, endings, denominators, n_c)


def contexts(ids: np.ndarray, n_out: int, starts: np.ndarray) -> np.ndarray:
    """The CONTEXT ids before each position; before a text's start stands the id n_out."""
    out = np.full((len(ids), CONTEXT), n_out, np.int32)
    place = np.arange(len(ids)) - starts
    for k in range(1, CONTEXT + 1):
        ok = place >= k
        out[ok, k - 1] = ids[np.flatnonzero(ok) - k]
    return out


class LogBilinear:
    """log p(w | context) = q . r_w + b_w - log Z, with q the weighted sum of the context's vectors."""

    def __init__(self, n_out: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.inner = rng.normal(0, 0.1, (n_out + 1, SIZE)).astype(np.float32)
        self.weights = (np.ones((CONTEXT, SIZE)) / np.arange(1, CONTEXT + 1)[:, None] ** 0.5).astype(np.float32)
        self.outer = rng.normal(0, 0.1, (n_out, SIZE)).astype(np.float32)
        self.bias = np.full(n_out, -np.log(max(1, n_out)), np.float32)
        self.grown: list[np.ndarray] = []  # AdaGrad's sums of squares, once training has begun
        self.learned = 0  # tokens that it has learned from

    def state(self) -> list[np.ndarray]:
        return [self.inner, self.weights, self.outer, self.bias, *self.grown]

    def begin(self, p: np.ndarray) -> None:
        self.bias = np.log(p).astype(np.float32)
        self.grown = [np.full(x.shape, 1e-3, np.float32) for x in (self.inner, self.weights, self.outer, self.bias)]

    def packed(self) -> np.ndarray:
        """All of the state, as one array."""
        return np.concatenate([x.ravel() for x in self.state()])

    def unpack(self, flat: np.ndarray) -> LogBilinear:
        ends = np.cumsum([x.size for x in self.state()])
        new = [x.reshape(y.shape).astype(np.float32) for x, y in zip(np.split(flat, ends[:-1]), self.state(), strict=True)]
        self.inner, self.weights, self.outer, self.bias, *self.grown = new
        return self

    def fit(self, ctx: np.ndarray, target: np.ndarray, seed: int = 2, counts: np.ndarray | None = None, epochs: int = EPOCHS) -> LogBilinear:
        """Noise-contrastive estimation: tell each word from NOISE draws of the unigram distribution (AdaGrad).

        The distribution is that of ``counts`` (by default of the targets). A network that has learned goes on from there.
        """
        rng, n_out = np.random.default_rng(seed), len(self.bias)
        p = (np.bincount(target, minlength=n_out) if counts is None else counts) + 0.5
        p = p / p.sum()
        if not self.grown:
            self.begin(p)
        shift = (np.log(p) + np.log(NOISE)).astype(np.float32)
        column = np.arange(SIZE)

        def summed(at: np.ndarray, rows: np.ndarray, like: np.ndarray) -> np.ndarray:
            """An array as ``like``: the sums of ``rows`` by their place in it."""
            return np.bincount((at[:, None] * SIZE + column).ravel(), weights=rows.ravel(), minlength=like.size).reshape(like.shape).astype(np.float32)

        def sigmoid(x: np.ndarray) -> np.ndarray:
            np.clip(x, -30, 30, out=x)
            np.negative(x, out=x)
            np.exp(x, out=x)
            x += 1
            return np.reciprocal(x, out=x)

        for epoch in range(epochs):
            order = rng.permutation(len(target))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                c, w = ctx[rows], target[rows]
                noise = rng.choice(n_out, NOISE, p=p)
                x, own, others = self.inner[c], self.outer[w], self.outer[noise]
                q = np.einsum("bkd,kd->bd", x, self.weights)
                good = 1 - sigmoid(np.einsum("bd,bd->b", q, own) + self.bias[w] - shift[w])
                bad = q @ others.T
                bad += self.bias[noise] - shift[noise]
                bad = sigmoid(bad)
                dq = good[:, None] * own - bad @ others
                d_outer = summed(np.concatenate([w, noise]), np.concatenate([good[:, None] * q, -(bad.T @ q)]), self.outer)
                d_bias = (np.bincount(w, weights=good, minlength=n_out) - np.bincount(noise, weights=bad.sum(axis=0), minlength=n_out)).astype(np.float32)
                d_inner = summed(c.ravel(), (dq[:, None] * self.weights).reshape(-1, SIZE), self.inner)
                d_weights = np.einsum("bkd,bd->kd", x, dq)
                for v, d, g in zip((self.inner, self.weights, self.outer, self.bias), (d_inner, d_weights, d_outer, d_bias), self.grown, strict=True):
                    d /= len(rows)
                    g += d * d
                    v += np.float32(RATE / (1 + epoch)) * d / np.sqrt(g)
        return self

    def log10(self, ctx: np.ndarray, target: np.ndarray, tile: int = 512) -> np.ndarray:
        """Normalised log10 probabilities: matrix products of tiles of contexts with all outputs."""
        out = np.empty(len(target), np.float64)
        table = np.concatenate([self.outer.T, self.bias[None]]).astype(np.float32)
        buffer, ones = np.empty((tile, len(self.bias)), np.float32), np.ones(len(self.bias), np.float32)
        for at in range(0, len(target), tile):
            c, w = ctx[at : at + tile], target[at : at + tile]
            q = np.ones((len(c), SIZE + 1), np.float32)
            q[:, :SIZE] = 0
            for k in range(CONTEXT):
                q[:, :SIZE] += self.inner[c[:, k]] * self.weights[k]
            s = np.dot(q, table, out=buffer[: len(c)])
            np.minimum(s, 80, out=s)
            mine = s[np.arange(len(c)), w].astype(np.float64)
            np.exp(s, out=s)
            out[at : at + tile] = mine - np.log((s @ ones).astype(np.float64))
        return out / np.log(10)


def numbered(counts: Counts, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words with ends, rank in the head or -1, output of the network, first place of each text)."""
    words, lengths = [], []
    for t in texts:
        w = words_of(t)
        words += w
        words.append(END)
        lengths.append(len(w) + 1)
    rank = np.fromiter(map(counts.head.get, words, repeat(-1)), np.int64, len(words))
    ids = counts.ids[rank] if len(counts.ids) else np.zeros(len(words), np.int32)
    rare = np.flatnonzero(rank < 0)
    ids[rare] = [counts.other(words[i]) for i in rare]
    return words, rank, ids, np.cumsum(lengths) - lengths


def rounds(shares: int) -> list[tuple[int, int]]:
    """(first, end) of the shares of each round: one, then WIDER times as many as all before."""
    out, done = [], 0
    while done < shares:
        end = min(shares, done + max(1, WIDER * done))
        out.append((done, end))
        done = end
    return out


def encoded(docs: DataFrame, counts: Counts) -> DataFrame:
    """All columns of ``docs`` but its text, and of each text: ids (of the network's outputs, as bytes), n_tokens, and
    sums over its tokens: n_head (tokens of the head), head_score (log10 of their counts), class_score (log10 of their
    shares of their classes); rare and times, the tokens beyond the head and how often each stands there.
    """
    given = docs.sparkSession.sparkContext.broadcast(counts)
    kind = counts.kind

    def make():
        counts = given.value
        logc = np.concatenate([np.log10(counts.c + 0.5), [0.0]])  # the last stands for a rare word, added later
        norms = np.log10(counts.denominators)

        def find(texts: list[str]):
            words, rank, ids, first = numbered(counts, texts)
            ends_ = np.append(first, len(ids))
            c = logc[rank]
            total = lambda x: np.add.reduceat(x, first)
            own = np.where(counts.denominators[ids] == 1.0, 0.0, c - norms[ids])
            # distinct rare words of each text, with their numbers
            rare = np.flatnonzero(rank < 0)
            doc = np.searchsorted(first, rare, "right") - 1
            tokens, times, ends = [], [], [0]
            for k in range(len(texts)):
                got = Counter(words[i] for i in rare[np.searchsorted(doc, k) : np.searchsorted(doc, k, "right")])
                tokens += got
                times += got.values()
                ends.append(len(tokens))
            offsets, small = pa.array(ends, pa.int32()), ids.astype(kind)
            return None, [
                pa.array([small[i:j].tobytes() for i, j in zip(ends_[:-1], ends_[1:], strict=True)], pa.binary()),
                pa.array(np.diff(ends_), pa.int64()), pa.array(total((rank >= 0).astype(np.int64)), pa.int64()), pa.array(total(c), pa.float64()), pa.array(total(own), pa.float64()),
                pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
            ]

        return find

    out = "ids binary, n_tokens long, n_head long, head_score double, class_score double, rare array<binary>, times array<int>"
    return map_texts(docs, [c for c in docs.columns if c != "text"], make, out)


def fit(part: DataFrame, counts: Counts, train_docs: int = TRAIN_DOCS) -> LogBilinear:
    """Trains on all rows of ``part`` (doc_id, deal, ids, of ``encoded``), dealt by the hash ``deal`` into shares of train_docs rows (in expectation).

    The shares of a round start from the same network, each learns in a task of its own, and the average of their
    networks (by tokens) is where the next round starts. The first share is gone through EPOCHS times, the others once. What is learned doesn't depend on how the input is partitioned.
    """
    spark = part.sparkSession
    shares = max(-(-part.count() // train_docs), -(-counts.total // TRAIN_TOKENS))
    model = LogBilinear(counts.n_out)
    if not shares:
        return model
    p = counts.sums + 0.5
    model.begin(p / p.sum())
    given = spark.sparkContext.broadcast(counts)
    kind = counts.kind
    scratch = Scratch(spark)
    ids = part.select("doc_id", F.pmod("deal", F.lit(shares)).cast("int").alias("share"), "ids")
    for first, end in rounds(shares):
        now = spark.sparkContext.broadcast(model)

        epochs = 1 if first else EPOCHS  # the first share sets out from nothing

        def learn(batches, now=now, epochs=epochs):
            found: dict[int, list[bytes]] = {}
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found.setdefault(k, []).append(x)
            for k in sorted(found):
                parts = found.pop(k)
                n = np.array([len(x) for x in parts]) // np.dtype(kind).itemsize
                own = np.frombuffer(b"".join(parts), kind).astype(np.int32)
                start = LogBilinear(given.value.n_out)
                start.grown = now.value.grown
                start.unpack(now.value.packed())
                start.fit(contexts(own, given.value.n_out, np.repeat(np.cumsum(n) - n, n)), own, 2 + k, given.value.sums, epochs)
                yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64()), pa.array([start.packed().tobytes()], pa.binary())], names=["n", "state"])

        own = ids.where((F.col("share") >= first) & (F.col("share") < end))
        dealt = own.repartitionById(end - first, F.col("share") - first).sortWithinPartitions("share", "doc_id", "ids").select("share", "ids")
        learned = scratch.keep(dealt.mapInArrow(released(learn), "n long, state binary"))
        total, state = 0, np.zeros(model.packed().size)
        for r in learned.toLocalIterator():
            total += r["n"]
            state += r["n"] * np.frombuffer(r["state"], np.float32).astype(np.float64)
        if total:
            model.unpack(state / total)
            model.learned += total
        now.unpersist()
        scratch.drop(learned)
    model.grown = []
    return model


def scored(docs: DataFrame, *, modulus: int = 5, held: int = 1, head: int = HEAD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from rows that are not held out. Null and empty texts are the end alone. A null doc_id is
    neither learned from nor held out; repeated rows are scored each. With nothing to learn from, all
    counts are 0 and the network is uniform.
    """
    spark = docs.sparkSession
    bucket = bucket_of("doc_id", modulus)
    docs = docs.select("doc_id", F.coalesce(bucket == held, F.lit(False)).alias("held_out"), F.coalesce(bucket != held, F.lit(False)).alias("learn"), F.xxhash64("doc_id", "text", F.lit("lm")).alias("deal"), "text")
    scratch = Scratch(spark)
    table = scratch.keep(count_words(docs.where("learn").select("text")))
    counts = digest(table, head)
    part = scratch.keep(encoded(docs, counts).withColumn("_row", F.monotonically_increasing_id()))  # a key, as it is now written
    model = fit(part.where("learn"), counts, train_docs)
    given = spark.sparkContext.broadcast(model)
    kind, n_out = counts.kind, counts.n_out
    base_norm = float(np.log10(counts.total + 0.5 * (counts.distinct + 1)))

    def score(batches):
        model = given.value
        for b in batches:
            all_ids, total = b.column(0).to_pylist(), []
            for i, j in chunks(all_ids):
                n = np.array([len(x) for x in all_ids[i:j]]) // np.dtype(kind).itemsize
                ids, first = np.frombuffer(b"".join(all_ids[i:j]), kind).astype(np.int32), np.cumsum(n) - n
                total.append(np.add.reduceat(model.log10(contexts(ids, n_out, np.repeat(first, n)), ids), first))
            if total:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate(total))], names=[*b.schema.names[1:], "lm_score"])

    own = part.select("ids", "_row", "doc_id", "held_out", "n_tokens", "n_head", "head_score", "class_score")
    own = own.mapInArrow(released(score), T.StructType([*own.schema.fields[1:], T.StructField("lm_score", T.DoubleType())]))
    rare = part.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("_row", F.col("x.rare").alias("token"), F.col("x.times").alias("n"))
    found = rare.join(table, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = found.groupBy("_row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    extra = F.coalesce("more", F.lit(0.0))
    base = F.col("head_score") + extra - F.col("n_tokens") * F.lit(base_norm)
    return own.join(more, "_row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("lm_score") + F.col("class_score") + extra).alias("score"))
