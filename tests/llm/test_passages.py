"""Repeated passages where third documents hold a part of them: no link may be lost."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from ravelin.llm import passages
from ravelin.llm.common import WordHashes, word_hash

SCHEMA = "doc_id long, text string"


def sentence(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def runs_left(rows, n):
    """Runs of n words that two documents hold."""
    at = defaultdict(set)
    for r in rows:
        w = r.text.lower().split()
        for k in range(len(w) - n + 1):
            at[tuple(w[k : k + n])].add(r.doc_id)
    return [v for v in at.values() if len(v) > 1]


def test_a_third_copy_cut_at_both_ends(spark):
    """Two documents share 55 words; a third holds words 5 to 51 of them, and may be the one that all are linked to."""
    rng, rows = random.Random(1), []
    for i in range(150):
        p = sentence(rng, 55)
        for k, part in enumerate((p, p, p[5:51])):
            rows.append((3 * i + k, " ".join([*sentence(rng, 30 + rng.randrange(40)), *part, *sentence(rng, 40)])))
    d = spark.createDataFrame(rows, SCHEMA)
    found = passages.passages(d).collect()
    assert {r.doc_id for r in found} == {3 * i + k for i in range(150) for k in (0, 1)}
    assert not runs_left(passages.without_repeats(d).collect(), 51)


def test_documents_that_hold_a_part_of_a_long_passage(spark):
    """A passage of 200 words in two texts of 800, and 48 words each of it in four others: it is found whole."""
    rng, rows, at = random.Random(2), [], {}
    for i in range(60):
        p = sentence(rng, 200)
        for k in range(2):
            before = sentence(rng, 300)
            at[6 * i + k] = len(before)
            rows.append((6 * i + k, " ".join([*before, *p, *sentence(rng, 300)])))
        for k in range(4):
            rows.append((6 * i + 2 + k, " ".join([*sentence(rng, 50), *p[50 * k : 50 * k + 48], *sentence(rng, 50)])))
    found = {r.doc_id: r for r in passages.passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(found) == set(at)
    assert all(r.start <= at[i] and r.start + r.length >= at[i] + 200 for i, r in found.items())


def test_near_copies_beside_parts_of_them(spark):
    """Two copies differ in one word of 120; shorter parts of the passage stand in other documents."""
    rng, rows, want = random.Random(3), [], set()
    for i in range(60):
        p = sentence(rng, 120)
        q = list(p)
        q[60] = "edited"
        for k, part in enumerate((p, q, p[:40], p[20:64], q[50:95], p[80:])):
            rows.append((6 * i + k, " ".join([*sentence(rng, 40), *part, *sentence(rng, 40)])))
        want |= {6 * i, 6 * i + 1}
    found = passages.passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in found} == want and all(r.length >= 118 for r in found)
    assert sum(r.kept for r in found) == 60


def test_mixed_texts_against_all_pairs(spark):
    """Texts made of overlapping pieces of a few sources: what is left has no run of 51 words twice."""
    rng, rows = random.Random(4), []
    sources = [sentence(rng, 400) for _ in range(12)]
    for i in range(300):
        w = []
        for _ in range(rng.randrange(1, 5)):
            s, a = rng.choice(sources), rng.randrange(380)
            w += [*s[a : a + rng.randrange(10, 120)], *sentence(rng, rng.randrange(30))]
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, SCHEMA)
    held = set().union(*runs_left(d.collect(), 51))
    found = passages.passages(d).collect()
    assert held <= {r.doc_id for r in found}
    left = passages.without_repeats(d).collect()
    assert not runs_left(left, 51)
    # nothing vanishes: runs of 5 words that were there are there once still, but for those that a cut parts
    before = {tuple(w[k : k + 5]) for _, t in rows for w in [t.split()] for k in range(0, len(w) - 4, 7)}
    after = {tuple(w[k : k + 5]) for r in left for w in [r.text.split()] for k in range(len(w) - 4)}
    assert len(before - after) <= 0.08 * len(before)


def test_a_very_common_line_has_a_bounded_number_of_links(spark):
    rng = random.Random(5)
    line = sentence(rng, 30)
    rows = [(i, " ".join([*sentence(rng, 30), *line, *sentence(rng, 30)])) for i in range(2000)]
    assert passages.passages(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_words_of_equal_crc32_differ():
    pairs = [("olbfmjqn", "fomlonrv"), ("plumless", "buckeroo"), ("codding", "gnu")]
    assert all(word_hash(a) != word_hash(b) for a, b in pairs)
    assert len(set(WordHashes().of([f"word{i}" for i in range(100_000)]).tolist())) == 100_000


def test_merged_unites_touching_spans(spark):
    d = spark.createDataFrame([(1, 0, 10), (1, 5, 8), (1, 10, 12), (1, 20, 30), (2, 3, 4), (2, 3, 9)], "rid long, s int, e int")
    assert sorted(tuple(r) for r in passages.merged(d, "rid", "s", "e").collect()) == [(1, 0, 12), (1, 20, 30), (2, 3, 9)]


@pytest.mark.parametrize("seed", range(5))
def test_onward_tells_where_a_part_ends(seed):
    a = np.random.default_rng(seed).integers(1, 2**60, 300).astype(np.uint64)
    got = passages.common_spans(a[100:200], a, [(50, 150)], 50, 0.8, starts=False, ends=False)
    assert got.spans == [(0, 100, 100, 200)] and got.onward == [(0, 100), (99, 199)]


def test_columns_with_the_names_used_inside(spark):
    rng = random.Random(6)
    p = sentence(rng, 60)
    names = ["rid", "_rid", "_may", "_cuts", "cuts", "row", "_bitmap", "_bucket", "key", "text_", "s", "e"]
    rows = [(i, " ".join([*sentence(rng, 60), *(p if i < 3 else [])]), *range(len(names))) for i in range(8)] + [(8, None, *range(len(names))), (9, "", *range(len(names)))]
    d = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} long" for n in names))
    out = passages.without_repeats(d)
    assert out.columns == d.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 10 and all(tuple(r)[2:] == tuple(range(len(names))) for r in got.values()) and got[8].text is None and got[9].text == ""
    assert sum(len(got[i].text.split()) == 120 for i in range(3)) == 1 and sum(len(got[i].text.split()) == 60 for i in range(3)) == 2


def test_components_of_long_chains(spark):
    from ravelin.llm.common import Scratch
    from ravelin.llm.graph import components

    rng = random.Random(5)
    ids = rng.sample(range(-(10**9), 10**9), 400)
    chains = [ids[i : i + 200] for i in (0, 200)]
    scratch = Scratch(spark)
    got = {r.node: r.label for r in components(spark.createDataFrame([e for c in chains for e in zip(c, c[1:])], "a long, b long"), scratch).collect()}
    assert got == {x: min(c) for c in chains for x in c}
    assert scratch.n <= 2 + 14  # tables written: edges, first labels, and one a round


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_write_few_tables(spark, shape):
    from ravelin.llm.common import Scratch
    from ravelin.llm.graph import components

    rng = random.Random(3)
    edges = {"chain": [(i, i + 1) for i in range(1000)], "star": [(700, i) for i in range(1000)], "random": [(rng.randrange(900), rng.randrange(900)) for _ in range(700)]}[shape] + [(5000, 5000)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    while any(label[a] != label[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    scratch = Scratch(spark)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == label
    assert scratch.n <= {"chain": 16, "star": 6, "random": 10}[shape]  # the edges, two tables a round, the labels
    assert len(list(Path(scratch.root.removeprefix("file:")).iterdir())) == 1  # all but the labels are gone


def test_copies_are_folded_without_a_shuffle_of_texts(spark):
    from ravelin.llm.common import Scratch

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    rng = random.Random(8)
    texts = [" ".join(f"{rng.randrange(10**12)}" for _ in range(1500)) for _ in range(60)]
    rows = [(100 * i + k, t) for i, t in enumerate(texts) for k in range(3 if i < 40 else 1)] + [(0, texts[0]), (5900, texts[59]), (7, None), (8, ""), (9, "")]
    d = spark.createDataFrame(rows, "rid long, text string").repartition(4).localCheckpoint()
    before = shuffled()
    docs, copies = passages.folded(d, Scratch(spark), 50)
    got = sorted(tuple(r) for r in docs.collect())
    assert got == sorted([(100 * i, t) for i, t in enumerate(texts)] + [(8, "")])
    assert sorted(tuple(r) for r in copies.collect()) == [(100 * i + k, 100 * i, 0, 1500, 0, 1500) for i in range(40) for k in (1, 2)]
    # the two texts whose row occurs twice, and no other
    assert shuffled() - before < sum(map(len, texts)) / 4


def random_graph(rng, nodes: int, edges: int) -> tuple[list, dict]:
    """Edges (ends may be equal, and edges repeat), and the least node of each node's component."""
    ids = rng.sample(range(-(10**12), 10**12), nodes)
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(edges)] + list(zip(ids[: nodes // 4], ids[1 : nodes // 4]))
    up = {x: x for a, b in pairs if a != b for x in (a, b)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return pairs, {x: root(x) for x in up}


@pytest.mark.parametrize("local", [0, 60, 1 << 18])
def test_components_by_rounds_and_in_one_task(spark, local):
    """All edges by rounds; by rounds until few are left; all in one task."""
    from ravelin.llm.common import Scratch
    from ravelin.llm.graph import components

    edges, want = random_graph(random.Random(11), 900, 500)
    scratch = Scratch(spark)
    got = components(spark.createDataFrame(edges, "a long, b long"), scratch, local).collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)
    assert len(list(Path(scratch.root.removeprefix("file:")).iterdir())) == 1
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), scratch, local).collect() == []


def test_components_of_few_edges_need_few_stages(spark):
    """The driver holds each stage's plan and tasks, so a small graph must not take rounds of them."""
    from ravelin.llm.common import Scratch
    from ravelin.llm.graph import components

    edges, _ = random_graph(random.Random(12), 900, 500)
    sc, scratch = spark.sparkContext, Scratch(spark)
    edges = scratch.keep(spark.createDataFrame(edges, "a long, b long"))
    sc.setJobGroup("few stages", "components")
    try:
        components(edges, scratch)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("few stages")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert 0 < len({s for j in jobs for s in j.stageIds}) <= 8
