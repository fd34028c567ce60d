"""Operators on training data: brute-force versions, edge cases, odd columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import language, lm, mixing, neardup, packing, passages, sharding, toxicity, vectors
from ravelin.llm.common import sieve

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with names that operators use."""
    rng = random.Random(1)
    rows = [(i, sentence(rng, 60), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, None, None, None, None), (None, "some words here", "en", "s1", 3), (101, "", "de", "s0", 0), (102, " \n\t ", None, "s0", 4), (103, "word " * 30_000, "en", None, 5)]
    rows += [(104, "twice the same row", "en", "s2", 6)] * 2 + [(105, "<|endoftext|> ünïcödé 漢字 \U0001f600", "fr", "S2", 7)]
    d = spark.createDataFrame(rows, SCHEMA)
    return d.withColumns({"size": F.lit(3), "node": F.lit("x"), "key": F.lit(1), "label": F.lit("y"), "shard": F.lit(9), "score": F.lit(0.5)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- toxicity ---
def test_toxicity(spark, data, documents, odd, empty):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    out = toxicity.scored(documents, labels)
    rows = {r.doc_id: r for r in out.join(labels, "doc_id").collect()}
    assert out.count() == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    clean = [r for r in rows.values() if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.1 * len(clean)
    bad = [r for r in rows.values() if r.toxic]
    assert sum(r.predicted for r in bad) >= 0.6 * len(bad)
    none = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.scored(odd, none).count() == odd.count()
    assert toxicity.scored(empty, labels).count() == 0
    assert toxicity.clean(documents, labels).columns == documents.columns


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=300), rng.random(300)
    at, value = toxicity.isotonic(x, y)
    fit = np.interp(np.sort(x), at, value)
    assert (np.diff(fit) >= -1e-12).all() and abs(fit.mean() - y.mean()) < 0.05
    assert toxicity.isotonic(np.array([1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0]))[1].tolist() == [0, 0, 0.5, 0.5]


def test_features_see_disguise():
    tokens = toxicity.Tokens(toxicity.Lexicon())
    f = dict(zip(toxicity.FEATURES, toxicity.features("You are an 1d10t and st00pid !!!", tokens), strict=True))
    assert f["disguised_insults"] > 0 and f["near_second"] > 0 and f["exclaims"] > 0
    assert not any(toxicity.features("", tokens)[:14])


# --- language ---
def test_language(spark, documents, odd, empty):
    out = language.identified(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    rows = {r.doc_id: r for r in language.identified(odd).collect()}
    assert rows[100].lang_pred == rows[101].lang_pred == rows[102].lang_pred == "und" and len(rows) == odd.select("doc_id").distinct().count()
    assert language.identified(empty).count() == 0


def test_language_mixture(documents):
    model = language.fit(documents)
    en, de = (documents.where(F.col("lang") == x).orderBy("doc_id").first()["text"][:1500] for x in ("en", "de"))
    (pred, share, shares), (one, *_rest) = model.mixtures([en + " " + de, en])
    assert set(shares) == {"en", "de"} and abs(shares["en"] - 0.5) < 0.2 and one == "en" and pred in shares and share == max(shares.values())


# --- passages ---
def test_passages_catch_planted_repeats(spark, odd, empty):
    rng = random.Random(5)
    planted = sentence(rng, 55)
    near = planted.replace(planted.split()[27], "edited")
    rows = [(i, sentence(rng, 120), "en", "a", 0) for i in range(20)]
    for i, p in ((2, planted), (7, planted), (11, near)):
        a, b = rows[i][1][:200], rows[i][1][200:]
        rows[i] = (i, f"{a} {p} {b}", "en", "a", 0)
    d = spark.createDataFrame(rows, SCHEMA)
    found = passages.passages(d).collect()
    assert {2, 7} <= {r.doc_id for r in found} <= {2, 7, 11}
    assert sum(r.kept for r in found) == 1 and len({r.class_id for r in found}) == 1
    after = {r.doc_id: r.text for r in passages.without_repeats(d).collect()}
    assert sum(planted in t for t in after.values()) == 1
    assert all(after[i] == rows[i][1] for i in range(20) if i not in (2, 7, 11))
    assert passages.passages(empty).count() == 0 and passages.without_repeats(empty).count() == 0
    kept = passages.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_passages_against_all_pairs(spark, documents):
    texts = {r.doc_id: r.text.lower().split() for r in documents.collect()}
    at = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 50):
            at[tuple(w[k : k + 51])].add(i)
    want = set().union(*[v for v in at.values() if len(v) > 1])
    found = {r.doc_id for r in passages.passages(documents).collect()}
    assert want <= found
    left = defaultdict(set)
    for r in passages.without_repeats(documents).collect():
        w = r.text.lower().split()
        for k in range(len(w) - 50):
            left[tuple(w[k : k + 51])].add(r.doc_id)
    assert not any(len(v) > 1 for v in left.values())


def test_passages_in_an_unevenly_edited_copy():
    rng = np.random.default_rng(7)
    one = rng.integers(1, 2**60, 180).astype(np.uint64)
    other = one.copy()
    for k in (*range(4, 60, 8), 100, 140):  # a heavily edited template, then 120 words with two substitutions
        other[k] += np.uint64(1)
    assert passages.jaccard(one, other) < 0.8 <= passages.jaccard(one[60:], other[60:])
    found = passages.common_spans(one, other, [(120, 120)], 50, 0.8).spans
    assert any(s <= 61 and e == 180 for s, e, _, _ in found)
    assert all(passages.jaccard(one[s:e], other[t:u]) >= 0.8 for s, e, t, u in found)
    assert passages.common_spans(one, one, [(20, 20)], 50, 0.8).spans == [(0, 180, 0, 180)]


# --- language model ---
def test_lm(spark, documents, odd, empty):
    rows = documents.select("doc_id", "text").collect()
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = {r.doc_id: r for r in lm.scored(documents, train_docs=100, head=500).collect()}
    for i, t in rows:
        r, base = out[i], sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.train_tokens == n and r.n_tokens == len(tokens(t)) and r.n_known == sum(c[w] > 0 for w in tokens(t))
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.scored(odd, train_docs=20).count() == odd.count() and lm.scored(empty).count() == 0


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    m = lm.LogBilinear(30).fit(rng.integers(0, 31, (500, lm.CONTEXT)), rng.integers(0, 30, 500))
    ctx = np.repeat(rng.integers(0, 31, (1, lm.CONTEXT)), 30, axis=0)
    assert (10 ** m.log10(ctx, np.arange(30))).sum() == pytest.approx(1.0, abs=1e-5)


def test_lm_learns_from_all_documents(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, sentence(rng, 30)) for i in range(300)], "doc_id long, text string")
    counts = lm.digest(lm.count_words(docs))
    one, other = (lm.fit(lm.encoded(docs.repartition(n).withColumn("deal", F.xxhash64("doc_id", "text")), counts), counts, 40) for n in (1, 7))
    assert one.learned == other.learned == counts.total == 300 * 31
    assert np.allclose(one.outer, other.outer, atol=1e-5) and np.allclose(one.inner, other.inner, atol=1e-5)
    assert [x for a, b in lm.rounds(51) for x in range(a, b)] == list(range(51))


def test_lm_vocabulary_grows(spark):
    token, c = F.concat(F.lit("w"), F.col("id")).cast("binary").alias("token"), F.when(F.col("id") < 1000, 100).otherwise(1).cast("long").alias("c")
    small, large = (lm.digest(spark.range(n).select(token, c)) for n in (2_000, 4_000_000))
    assert (small.denominators == 1).sum() == lm.WORDS < (large.denominators == 1).sum()


# --- vectors ---
def vector_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)], 0) for i in range(400)]
    rows += [(400 + i, rows[0][1], 1) for i in range(60)]
    rows += [(1000, None, 0), (1100, [1.0] * 7 + [None], 0), (1200, [float("nan")] * 8, 0), (1300, [0.0] * 8, 0), (None, [1.0] * 8, 0), (1400, [float("inf")] * 8, 0), (1500, [], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vectors(spark):
    rows, d = vector_rows(spark)
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = set()
    for q, v in ok:
        if q % 50 == 0:
            s = sorted((-int(np.floor(256 * v) @ np.floor(256 * w)), i) for i, w in ok if i != q)[:5]
            want |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s)}
    assert {tuple(r) for r in vectors.exact_top_k(d).collect()} == want
    want = set()
    for q, v in ok:
        if q % 100 == 0 and v.any():
            s = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in ok if i != q and w.any())[:10]
            want |= {(q, i) for _, i in s}
    found = {(r.query_id, r.vec_id) for r in vectors.nearest(d).collect()}
    assert len(found & want) >= 0.9 * len(want)
    none = d.limit(0)
    assert vectors.exact_top_k(none).count() == 0 and vectors.nearest(none).count() == 0


# --- mixing ---
def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, t, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(t.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            t |= share
            break
        t |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return t


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_mixing(request, which):
    d = request.getfixturevalue(which)
    out = mixing.mixed(d).collect()
    given = d.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in given:
        sizes[r.source] += len(words(r.text))
    targets = brute_targets(sizes)
    assert len(out) == len(given) and all(0 <= r.taken <= 2 * r.size for r in out)
    assert Counter((r.doc_id, r.size, round(r.target, 3)) for r in out) == Counter((r.doc_id, len(words(r.text)), round(targets[r.source], 3)) for r in given)
    taken = Counter()
    for r in out:
        taken[round(r.target, 3), r.source_size] += r.taken
    for s, n in sizes.items():
        same = sum(1 for x in sizes if (round(targets[x], 3), sizes[x]) == (round(targets[s], 3), n))
        assert taken[round(targets[s], 3), n] == pytest.approx(same * targets[s], rel=0.02, abs=same * 64)
    assert Counter(mixing.mixed(d).collect()) == Counter(out)


def test_mixed_texts(odd, documents, empty):
    for d in (documents, odd):
        plain = Counter()
        for r in mixing.resampled(d).collect():
            plain[r.source] += len(words(r.text))
            assert r.n_chars == len(r.text)
        targets = brute_targets(Counter({s: n for s, n in ((r[0], r[1]) for r in d.groupBy("source").agg(F.sum(mixing.n_words(F.col("text")))).collect())}))
        assert all(plain[s] == pytest.approx(t, rel=0.02, abs=64) for s, t in targets.items())
    assert mixing.resampled(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_permutation(spark):
    for n in (1, 2, 3, 7, 100, 1023):
        d = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p"))
        assert sorted(r.p for r in d.collect()) == list(range(n))


# --- packing ---
def test_packing(spark, odd, documents, empty):
    by_library = [{(r.doc_id, r.piece): r.ids_crc32 for r in packing.pieces(documents, library=x).collect()} for x in ("tiktoken", "tokenizers")]
    assert by_library[0] == by_library[1]
    odd_pieces = [Counter(r for r in packing.pieces(odd, library=x).collect()) for x in ("tiktoken", "tokenizers")]
    assert odd_pieces[0] == odd_pieces[1]
    for d in (documents, odd):
        rows = packing.packed(d).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(r.length for r in rows)
        assert len(by) <= -(-total // 2048) * 1.02 + 1
        assert all(r.length == 2048 for r in rows if r.piece > 0)
    assert packing.packed(empty).count() == 0


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(20):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 200))]
        gaps = []
        for s in sorted(sizes, reverse=True):
            fit = [i for i, g in enumerate(gaps) if g >= s]
            if fit:
                gaps[min(fit, key=lambda i: gaps[i])] -= s
            else:
                gaps.append(100 - s)
        used = {first + k for length, _, took, first, each, _ in packing.best_fit(Counter(sizes), 100) for k in range(-(-took // each))}
        assert len(used) == len(gaps) and used == set(range(len(gaps)))


# --- sharding ---
def test_sharding(odd, documents, empty):
    rows = sharding.shard(documents, shards=8).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 2 * max(r.size for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    out = sharding.shard(odd).collect()
    assert len(out) == odd.count() and all(0 <= r.shard < 40 for r in out) and {r.size for r in out if r.doc_id == 100} == {16}
    assert sharding.shard(empty).count() == 0


def test_sharding_cuts_a_hot_text(spark):
    rows = [(i, "the very same text", "en", "a", 0) for i in range(3000)] + [(10_000 + i, f"text {i}", "en", "a", 0) for i in range(3000)]
    load = Counter(r.shard for r in sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=10).collect())
    assert max(load.values()) < 1.6 * min(load.values())


# --- near duplicates ---
def test_near_duplicates(spark, documents, odd, empty):
    def shingles(t):
        w = t.lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(r.doc_id, shingles(r.text)) for r in documents.collect()]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            both = len(x & y)
            if x and y and both >= 0.8 * (len(x) + len(y) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    found = {r.doc_id: r for r in neardup.classes(documents).collect()}
    assert all(found[i].class_id == root(i) for i, _ in sets)
    assert all(found[i].kept == (root(i) == i) for i, _ in sets)
    kept = neardup.deduplicated(documents)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in sets if root(i) == i} and kept.columns == documents.columns
    rest = neardup.deduplicated(odd)
    assert rest.columns == odd.columns and rest.where("doc_id = 104").count() == 1 and rest.where("doc_id in (100, 101, 102)").count() == 3
    assert neardup.classes(empty).count() == 0 and neardup.deduplicated(empty).count() == 0


def test_near_duplicates_through_an_original(spark):
    """Copies that are links of their original, but hardly of each other, are one class; strangers stay out."""
    rng = random.Random(9)
    base = sentence(rng, 200).split()

    def edited(n):
        w = list(base)
        for p in rng.sample(range(len(w)), n):
            w[p] = "edit" + str(rng.randrange(10**6))
        return " ".join(w)

    rows = [(0, " ".join(base), "en", "a", 0)] + [(i, edited(4), "en", "a", 0) for i in range(1, 80)] + [(i, edited(25), "en", "a", 0) for i in range(80, 120)]
    size = lambda t: {tuple(t.split()[k : k + 5]) for k in range(196)}
    b = size(rows[0][1])
    near = {i for i, t, *_ in rows if len(size(t) & b) / len(size(t) | b) >= 0.8}
    found = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, c in found.items() if c == 0} == near


def test_dart_minhash():
    rng = np.random.default_rng(0)
    seen = []
    for _ in range(30):
        e = rng.integers(0, 2**63, 200).astype(np.uint64)
        w = rng.gamma(2.0, 1.0, 200)
        v = w * rng.uniform(0.5, 1.0, 200)
        same = (neardup.dart_minhash(e, w) == neardup.dart_minhash(e, v)).mean()
        seen.append((same, np.minimum(w, v).sum() / np.maximum(w, v).sum(), (neardup.dart_minhash(e[:180]) == neardup.dart_minhash(e[20:])).mean()))
    est, true, plain = np.mean(seen, axis=0)
    assert abs(est - true) < 0.02 and abs(plain - 0.8) < 0.02


def test_sieve(spark):
    keys = spark.range(0, 1000, 7).select("id")
    flagged = {r.id: r.may for r in sieve(keys)(spark.range(1000), "id", "may").collect()}
    assert all(flagged[i] for i in range(0, 1000, 7)) and sum(flagged.values()) < 160


def test_queries_in_several_rounds(spark, monkeypatch):
    _, d = vector_rows(spark)
    whole = {tuple(r) for r in vectors.exact_top_k(d, every=10).collect()}
    monkeypatch.setattr(vectors, "QUERY_CHUNK", 7)
    monkeypatch.setattr(vectors, "CHUNKS_AT_ONCE", 2)
    assert {tuple(r) for r in vectors.exact_top_k(d, every=10).collect()} == whole
