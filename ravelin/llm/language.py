"""Languages of a document as a mixture, by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bucket_of, chunks, map_texts

#: The language models are fitted on this many labelled documents at most, picked by a hash of their id.
TRAIN_DOCS = 20_000
BITS, ALPHA, LEAST, STEPS, PENALTY = 17, 0.05, 3, 10, 2.0
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, word, doc): for each letter the bin of the trigram around it and its word; for each word its text.

    Words are runs of letters, in lower case; what is no letter counts as one boundary sign.
    """
    joined = "\n".join(t.lower() for t in texts)
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letter_table()[c]
    c = np.where(is_letter, c, 0).astype(np.uint32)
    pad = np.concatenate([np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)])
    mixed = pad[:-2] * np.uint32(0x9E3779B1) ^ pad[1:-1] * np.uint32(0x85EBCA77) ^ pad[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(is_letter)
    first = at[~np.concatenate([[False], is_letter[:-1]])[at]] if len(at) else at
    word = np.searchsorted(first, at, "right") - 1
    return (mixed[at] >> np.uint32(32 - BITS)).astype(np.int64), word, np.searchsorted(ends, first, "right")


@dataclass
class LanguageModel:
    """languages, and log P(gram | language) as bins x languages."""

    languages: list[str]
    logp: np.ndarray

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log-likelihood of each word under each language; the text of each word."""
        gram, word, doc = grams(texts)
        if not len(doc):
            return np.zeros((0, len(self.languages)), np.float32), doc
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return np.add.reduceat(self.logp[gram], starts, axis=0), doc

    def mixtures(self, texts: list[str]) -> list[tuple[str, float, dict[str, float]]]:
        """For each text (language, its share, shares of the chosen set); UNKNOWN without letters."""
        out = [(UNKNOWN, 0.0, {})] * len(texts)
        if not self.languages:
            return out
        ll, doc = self.likelihoods(texts)
        if not len(doc):
            return out
        docs, starts, n = np.unique(doc, return_index=True, return_counts=True)
        row = np.repeat(np.arange(len(docs)), n)
        total = lambda x: np.add.reduceat(x, starts, axis=0)
        top = ll.max(axis=1, keepdims=True)
        p = np.exp(np.maximum(ll - top, -60))
        base = total(top[:, 0].astype(np.float64))

        def fit(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pi = mask / mask.sum(axis=1, keepdims=True)
            for _ in range(STEPS):
                joint = p * pi[row].astype(np.float32)
                joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
                pi = total(joint).astype(np.float64) * mask
                pi /= np.maximum(pi.sum(axis=1, keepdims=True), 1e-30)
            seen = (p * pi[row].astype(np.float32)).sum(axis=1)
            return pi, base + total(np.log(np.maximum(seen, 1e-30)).astype(np.float64))

        every = len(self.languages)
        whole, _ = fit(np.ones((len(docs), every)))
        order = np.argsort(np.argsort(-whole, axis=1, kind="stable"), axis=1, kind="stable")
        best, best_pi = np.full(len(docs), -np.inf), whole
        for k in range(1, every + 1):  # the set grows, by share, while a text's penalised likelihood does
            pi, found = fit((order < k).astype(np.float64))
            found -= PENALTY * (k - 1) * np.log(n + 1.0)
            better = found > best
            if not better.any():
                break
            best, best_pi = np.where(better, found, best), np.where(better[:, None], pi, best_pi)
        pick = best_pi.argmax(axis=1)
        for i, d in enumerate(docs):
            shares = {self.languages[j]: float(best_pi[i, j]) for j in np.flatnonzero(best_pi[i] > 1e-6)}
            out[d] = (self.languages[pick[i]], min(1.0, float(best_pi[i, pick[i]])), shares)
        return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Fits trigram models on ``docs`` (doc_id, text, lang); rows without text or lang are left out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = known.count()
    if not n:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32))
    key = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    some = known.where(key < int((1 << 30) * min(1.0, train_docs / n))).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, part in b.groupby("lang"):
                texts = part["text"].tolist()
                for i, j in chunks(texts):
                    got = np.bincount(grams(texts[i:j])[0], minlength=1 << BITS)
                    sums[lang] = sums.get(lang, 0) + got
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pd.DataFrame({"lang": lang, "bin": at, "n": x[at]})

    got = some.mapInPandas(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).toPandas()
    languages = sorted(got["lang"].unique())
    counts = np.zeros((1 << BITS, len(languages)))
    counts[got["bin"], got["lang"].map({x: i for i, x in enumerate(languages)})] = got["n"]
    p = (counts + ALPHA) / (counts.sum(axis=0) + ALPHA * (1 << BITS)) if languages else counts
    return LanguageModel(languages, np.log(p).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """``keep`` columns of docs with lang_pred, score (share of that language) and n_langs (languages of the set), from the text alone."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = given.value

        def find(texts: list[str]):
            found = m.mixtures(texts)
            return None, [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([len(x[2]) for x in found], pa.int32())]

        return find

    return map_texts(docs, list(keep), make, "lang_pred string, score double, n_langs int")


def identified(docs: DataFrame, *, modulus: int = 5, held: int = 0, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and n_langs) of every document.

    Learns from rows that are not held out. A null or letterless text is UNKNOWN with score 0, and so is
    every text if nothing can be learned. A null doc_id is neither learned from nor held out. Repeated rows
    are scored each. Ties go to the language that comes first in order.
    """
    learn = docs.where(bucket_of("doc_id", modulus) != held).select("doc_id", "text", "lang")
    model = fit(learn, train_docs)
    d = docs.select("doc_id", F.coalesce(bucket_of("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "text")
    return predict(d, model, "doc_id", "held_out")

