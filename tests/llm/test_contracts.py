"""What all stages promise: clashing names, nulls, empty tables, repeated rows, and a repository without this folder."""

import random
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from ravelin.llm import lm, mixing, neardup, packing, passages, sharding, toxicity, vectors

ROOT = Path(__file__).parents[2]
#: Names that the operators use inside.
NAMES = "score rid _rid _may _bitmap _bucket _text _w _copy _parts _t0 size row key label shard node thash _id _source _order _start _row _block target taken x half cuts".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(11)
    p = text(rng, 80)
    rows = [(i, f"{text(rng, 60)} {p if i < 4 else ''}", "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (None, "some words here", "en", "s1", 3), (101, "", "de", "s0", 0), (102, " \n\t ", None, "s0", 4)]
    rows += [(104, "twice the same row", "en", "s2", 6)] * 2 + [(200 + i, rows[5][1], "en", "s1", 1) for i in range(30)]
    rows = [(*r, *range(len(NAMES))) for r in rows]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` long" for n in NAMES))


STAGES = {
    "toxicity": lambda d, labels: toxicity.clean(d, labels),
    "near_duplicates": lambda d, labels: neardup.deduplicated(d),
    "substring_dedup": lambda d, labels: passages.without_repeats(d),
    "mixing": lambda d, labels: mixing.resampled(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_all_columns(spark, clashing, name):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    out = STAGES[name](clashing, labels)
    assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
    rows = out.collect()
    assert rows and all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in rows)
    assert STAGES[name](clashing.limit(0), labels).count() == 0
    n = Counter(r.doc_id for r in rows)
    if name in ("toxicity", "substring_dedup"):
        assert len(rows) == clashing.count()
    if name == "near_duplicates":
        assert n[104] == 1 and sum(n[i] for i in (5, *range(200, 230))) == 1 and n[100] == n[101] == n[102] == n[None] == 1


def test_queries_with_clashing_columns(spark, clashing):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    n = clashing.count()
    for d in (toxicity.scored(clashing, labels), lm.scored(clashing), mixing.mixed(clashing), packing.packed(clashing), sharding.shard(clashing), neardup.classes(clashing)):
        assert d.count() == n
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)], 1, 2, "a") for i in (*range(0, 300, 10), 100, 100)], "vec_id long, embedding array<float>, v int, score long, ids string")
    for f in (vectors.exact_top_k, vectors.nearest):
        rows = f(v).collect()
        assert rows and all(r.query_id != r.vec_id for r in rows) and len({(r.query_id, r["rank"]) for r in rows}) == len(rows)
        assert f(v.limit(0)).count() == 0


def test_pipeline_stages_on_nothing(spark, data):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_identical_rows_are_dealt_over_shards(spark):
    d = spark.createDataFrame([(1, "the very same row")] * 4000 + [(i, f"row {i}") for i in range(2000)], "doc_id long, text string")
    rows = sharding.shard(d, shards=10).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert len(rows) == 6000 and max(load.values()) < 1.02 * min(load.values())


def test_the_rest_works_without_this_folder(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py"))
    for also in (False, True):
        if also:  # even where the pipeline's file was left
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path / "repo")
        code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert len(q) > 100 and 'pipeline' not in q and not any(k.startswith('op1') for k in q), q; assert set(s) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
