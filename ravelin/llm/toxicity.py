"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, boxed, bucket_of, chunks, map_texts, released

#: The classifier is fitted on this many labelled documents at most, picked by a hash of their id.
TRAIN_DOCS = 20_000
#: Learned lexicon entries kept, and the lower bound of their log odds that they must reach.
ENTRIES, LEAST_ODDS, Z = 6_000, 0.7, 2.5
CUTOFF = 0.3
TREES, DEPTH, RATE, LEAST_LEAF, BINS, L2 = 120, 3, 0.1, 5, 48, 1.0
NEAR = 6  # words between an insult and a second person

# Seed lexicon of common English insults and profanity.
INSULTS = frozenset("idiot idiots idiotic moron morons stupid dumb dumbass fool scum trash garbage worthless pathetic disgusting loser losers clown clowns imbecile cretin filth filthy vermin pig pigs coward liar freak creep ugly fat hate hateful shut bastard bitch crap damn hell shit shitty fuck fucking fucker asshole ass dick slut whore retard retarded jerk useless disgrace kill die".split())
# Second-person words of English, German, French, Spanish, Italian and Portuguese.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú usted ustedes vosotros vuestro tuyo ti voi voce você".split())
# Signs that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"})
BETWEEN = re.compile(r"[^\w$@!|+€]+|_+")
#: Letters of a token whose entry is remembered.
LONG = 64
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_/\\|~`"

FEATURES = ("insults", "insults_log", "learned", "learned_log", "learned_best", "learned_sum", "stems", "stems_log", "near_second", "second", "capitals", "exclaims", "questions", "punctuation", "digits", "disguised", "disguised_insults", "stretched", "words_log", "word_length")


@dataclass
class Lexicon:
    """Learned log odds of whole words and of word beginnings (4 and 5 letters)."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


class Tokens(dict):
    """token -> None, or (insult, learned odds, stem odds, second person, disguised, disguised insult, stretched)."""

    LIMIT = 150_000

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str):
        if len(self) > self.LIMIT:
            self.clear()
        word = token.strip(EDGES)
        plain, hidden = word.isalpha(), False
        bare = word
        if word and not plain:
            bare = "".join(c for c in word.translate(DISGUISE) if c.isalpha())
            hidden = any(c.isalpha() for c in word) and not any(c in "'’-" for c in word) and bare != word
        stretched = plain and any(word[i] == word[i + 1] == word[i + 2] for i in range(len(word) - 2))
        if stretched:
            bare = "".join(c for i, c in enumerate(word) if i == 0 or c != word[i - 1])
        odds = self.lexicon.words.get(bare, 0.0)
        stem = 0.0 if len(bare) < 5 else self.lexicon.stems.get(bare[:5]) or self.lexicon.stems.get(bare[:4], 0.0)
        insult = bare in INSULTS
        known = insult or odds > 0 or stem > 0
        found = (insult, odds, stem, word in SECOND, hidden, known and not plain, stretched)
        if not plain and (parts := [x for x in BETWEEN.split(word) if len(x) > 2])[1:]:  # words joined by signs
            rest = [x for p in parts if (x := self[p])]
            found = (found[0] or any(x[0] for x in rest), *(max([found[k], *(x[k] for x in rest)]) for k in (1, 2)), *(found[k] or any(x[k] for x in rest) for k in (3, 4, 5, 6)))
        found = found if any(found) else None
        if len(token) <= LONG:  # what is longer hardly comes again
            self[token] = found
        return found


def features(text: str, tokens: Tokens) -> list[float]:
    """The dense features of one text; all zero for an empty one."""
    words = text.lower().split()
    n = max(1, len(words))
    hits = [(i, x) for i, w in enumerate(words) if (x := tokens[w])]
    insult = sum(x[0] for _, x in hits)
    odds = [x[1] for _, x in hits if x[1] > 0]
    stems = [x[2] for _, x in hits if x[2] > 0]
    you = [i for i, x in hits if x[3]]
    bad = [i for i, x in hits if x[0] or x[1] > 0 or x[2] > 0]
    near = 0
    if you and bad:
        at = np.searchsorted(you, bad)
        y = np.asarray([-(10**9), *you, 10**9])
        near = int((np.minimum(np.asarray(bad) - y[at], y[at + 1] - np.asarray(bad)) <= NEAR).sum())
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper, lower, size = int(byte[65:91].sum()), int(byte[97:123].sum()), max(1, len(text))
    signs = int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum())
    count = lambda k: sum(x[k] for _, x in hits)
    return [
        insult / n, math.log1p(insult), len(odds) / n, math.log1p(len(odds)), max(odds, default=0.0), sum(odds) / math.sqrt(n), len(stems) / n, math.log1p(len(stems)),
        near / n, len(you) / n, upper / max(1, upper + lower), byte[33] / size, byte[63] / size, signs / size, int(byte[48:58].sum()) / size,
        count(4) / n, math.log1p(count(5)), count(6) / n, math.log(n), len(text) / n,
    ]


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, over binned features."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            cut = (v[:-1] + v[1:]) / 2
            self.edges.append(np.unique(cut[np.linspace(0, len(cut) - 1, BINS - 1).astype(int)]) if len(cut) >= BINS else cut)
        b = self.binned(x)
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        f = np.full(len(y), self.base)
        columns, m = np.arange(x.shape[1]) * BINS, x.shape[1] * BINS
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), int)
            split = np.full(2**DEPTH - 1, -1)
            at = np.zeros(2**DEPTH - 1, int)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                key = ((node - first)[:, None] * m + columns + b).ravel()
                hist = lambda w: np.bincount(key, np.repeat(w, x.shape[1]), minlength=width * m).reshape(width, x.shape[1], BINS).cumsum(axis=2)  # noqa: B023, E731
                gl, hl, nl = hist(g), hist(h), hist(np.ones(len(y)))
                gt, ht, nt = gl[:, :1, -1:], hl[:, :1, -1:], nl[:, :1, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = -1
                best = gain.reshape(width, -1).argmax(axis=1)
                good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                split[first : first + width] = np.where(good, best // BINS, -1)
                at[first : first + width] = best % BINS
                s = split[node]
                right = (s >= 0) & (b[np.arange(len(y)), np.maximum(s, 0)] > at[node])
                node = 2 * node + 1 + right
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + L2)
            self.trees.append((split, at, value))
            f += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for split, at, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                s = split[node]
                node = 2 * node + 1 + ((s >= 0) & (b[rows, np.maximum(s, 0)] > at[node]))
            f += value[node - (2**DEPTH - 1)]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the points of the best rising fit of y on x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, number, lowest x, highest x
    for v, t in zip(x[order], y[order], strict=True):
        if blocks and blocks[-1][3] == v:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([float(t), 1.0, float(v), float(v)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    return np.array([v for b in blocks for v in b[2:]]), np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


@dataclass
class ToxicityModel:
    """What scoring needs; ``constant`` serves where nothing could be fitted."""

    lexicon: Lexicon
    trees: Boosted | None = None
    points: tuple[np.ndarray, np.ndarray] | None = None
    constant: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            # without labels: any insult of the seed lexicon
            return np.where(x[:, 1] > 0, 0.5, self.constant) if len(x) else np.zeros(0)
        raw = self.trees.raw(x)
        # the trees' own probability breaks ties inside the steps of the calibration
        return np.clip(0.98 * np.interp(raw, *self.points) + 0.02 / (1 + np.exp(-raw)), 0, 1)


def fitted(x: np.ndarray, y: np.ndarray, lexicon: Lexicon) -> ToxicityModel:
    """Trees on two thirds of the rows each, calibrated on the scores of the third left out."""
    if len(y) < 30 or y.min() == y.max():
        return ToxicityModel(lexicon, constant=float(y.mean()) if len(y) else 0.0)
    fold, raw = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        part = y[fold != k]
        if part.min() == part.max():
            return ToxicityModel(lexicon, constant=float(y.mean()))
        raw[fold == k] = Boosted().fit(x[fold != k], part).raw(x[fold == k])
    return ToxicityModel(lexicon, Boosted().fit(x, y), isotonic(raw, y))


def grams_of(text: str) -> set[str]:
    """Words and word beginnings of a text, marked by kind."""
    words = {w for t in set(text.lower().split()) if (w := t.strip(EDGES)).isalpha()}
    return {f"w{w}" for w in words} | {f"s{w[:n]}" for w in words for n in (4, 5) if len(w) >= 5}


def learn_lexicons(train: DataFrame, scratch: Scratch) -> list[Lexicon]:
    """Words and stems that toxic documents hold far more often than others, by the lower bound of log odds.

    Three lexicons: from the rows of half 0, from those of half 1, from all.
    """
    totals = {(r[0], r[1]): r[2] for r in train.groupBy("half", "toxic").count().collect()}
    sums = ("bad0", "good0", "bad1", "good1")

    def run(batches):
        for b in batches:
            texts, place = b.column(0).to_pylist(), [2 * h + (not y) for y, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            for i, j in chunks([t or "" for t in texts]):
                found: dict[str, list[int]] = {}
                for t, k in zip(texts[i:j], place[i:j], strict=True):
                    for g in grams_of(t or ""):
                        found.setdefault(g, [0, 0, 0, 0])[k] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([x[k] for x in found.values()], pa.int64()) for k in range(4))], names=["gram", *sums])

    got = train.select("text", "toxic", "half").mapInArrow(released(run), "gram string, " + ", ".join(f"{x} long" for x in sums)).groupBy("gram").agg(*(F.sum(x).alias(x) for x in sums))
    got = scratch.keep(got.where("bad0 + bad1 >= 3")).withColumns({"bad2": F.col("bad0") + F.col("bad1"), "good2": F.col("good0") + F.col("good1")})
    out = []
    for k in range(3):
        bad, good = (sum(totals.get((h, y), 0) for h in ((0, 1) if k == 2 else (k,))) for y in (1, 0))
        if not bad or not good:
            out.append(Lexicon())
            continue
        b, g = F.col(f"bad{k}"), F.col(f"good{k}")
        odds = F.log((b + 0.5) / (bad + 1)) - F.log((g + 0.5) / (good + 1))
        low = odds - Z * F.sqrt(1 / (b + 0.5) + 1 / (g + 0.5))
        rows = got.select("gram", odds.alias("odds"), low.alias("low")).where(F.col("low") > LEAST_ODDS).orderBy(F.desc("low"), "gram").limit(ENTRIES).collect()
        out.append(Lexicon({r[0][1:]: r[1] for r in rows if r[0][0] == "w"}, {r[0][1:]: r[1] for r in rows if r[0][0] == "s"}))
    return out


def featured(docs: DataFrame, keep: list[str], lexicon: Lexicon) -> DataFrame:
    """keep columns and ``x``, the features of each text."""
    given = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        tokens = Tokens(given.value)
        return lambda texts: (None, [pa.array([features(t, tokens) for t in texts], pa.list_(pa.float64()))])

    return map_texts(docs, keep, make, "x array<double>")


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Fits on documents that ``labels`` (doc_id, toxic) marks; a document marked twice counts as its highest mark."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    key = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    some = known.where(key < int((1 << 30) * min(1.0, train_docs / max(1, n))))
    # at most about train_docs short rows, whatever the input: safe to broadcast
    scratch = Scratch(docs.sparkSession)
    train = scratch.keep(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")))
    first, second, lexicon = learn_lexicons(train, scratch)
    # each half is described by the lexicon of the other, so no row counts towards its own features
    rows = [r for h, x in ((0, second), (1, first)) for r in featured(train.where(F.col("half") == h), ["toxic", "doc_id"], x).collect()]
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    model = fitted(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["toxic"] for r in rows], float), lexicon)
    scratch.drop(train)
    return model


def score(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """keep columns and ``score`` of each text."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = given.value
        tokens = Tokens(m.lexicon)
        return lambda texts: (None, [pa.array(m.score(np.array([features(t, tokens) for t in texts]).reshape(-1, len(FEATURES))), pa.float64())])

    return map_texts(docs, keep, make, "score double")


def scored(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, held: int = 2, cutoff: float = CUTOFF, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Learns from labelled rows that are not held out. Null and empty texts get the score of a text without
    words. A null doc_id is neither learned from nor held out. With too few labels (under 30, or of one
    kind) the score is 0.5 for texts with a word of the seed lexicon and the share of toxic labels for
    others. Repeated rows are scored each; further columns are not read.
    """
    model = fit(docs, labels.where(bucket_of("doc_id", modulus) != held), train_docs)
    d = docs.select("doc_id", F.coalesce(bucket_of("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "text")
    out = score(d, model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, *, cutoff: float = CUTOFF, source: DataFrame | None = None, **options) -> DataFrame:
    """The documents (all columns as they are, whatever their names) whose score is below the cutoff.

    It learns from ``source`` (docs, if None). Labels that are null, neither 0 nor 1, or of no document are left out;
    without any, only a word of the seed lexicon rejects a text. Null and empty texts stay, however many they are;
    repeated rows are judged alike. An empty table stays empty.
    """
    model = fit(docs if source is None else source, labels, **options)
    d = boxed(docs, text=F.col("text"))
    return score(d, model, ["row"]).where(F.col("score") < cutoff).select("row.*")
