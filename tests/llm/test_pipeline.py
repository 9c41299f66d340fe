import collections

import corpus_pipeline
import numpy as np
import pytest

from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check

WORDS = {"aa": ["tha", "ing", "the", "was", "er", "on"], "bb": ["lich", "und", "keit", "der", "zu", "ge"]}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    g = np.random.default_rng(9)
    docs, labels = [], []
    for i in range(400):
        lang = list(WORDS)[i % 2]
        words = ["".join(g.choice(WORDS[lang], 2)) for _ in range(g.integers(12, 80))]
        if i % 4 < 2 and i % 3 == 0:
            for _ in range(3):
                words.insert(int(g.integers(len(words))), str(g.choice(["scum", "idiot", "moron"])))
        docs.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 1, int(i % 4 < 2 and i % 3 == 0)))
    docs += [(1000 + i, docs[2][1], "aa", "s", 0) for i in range(5)] + [(1010, docs[2][1] + " tha", "aa", "s", 0)]
    docs += [(2000, None, "aa", "s", 0), (2001, "123 ...", "bb", None, None), (2002, "", None, "s", 0), (None, docs[5][1], "bb", "s", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs, {i for i, _, t in labels if t}


def test_each_stage_and_the_whole(spark, tables):
    path, docs, toxic = tables
    now = spark.read.parquet(f"{path}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, path)
        assert after.columns == now.columns
        steps[name] = (now, [tuple(r) for r in after.collect()])
        now = spark.createDataFrame(steps[name][1], now.schema)
    left = {r[0] for r in steps["language_id"][1]}
    assert left == {d[0] for d in docs} - {2000, 2001, 2002}
    clean = [r for r in steps["toxicity"][1]]
    assert not toxic & {r[0] for r in clean} and left - toxic - {r[0] for r in clean} == set()
    groups = brute([(r[0], r[1]) for r in clean], 5, 80, 100)
    kept = collections.Counter(r[0] for r in steps["near_dedup"][1])
    assert set(kept.values()) == {1} and set(kept) == {d for d, _, c, _ in groups if d is not None and d == c}
    rows = [(r[0], r[1]) for r in steps["near_dedup"][1]]
    n, tokens = check(corpus_pipeline.run(spark, path), rows, 1024)
    assert n <= tokens / 1024 * 1.05 + 1


def test_empty_and_clashing_tables(spark, tables, tmp_path):
    """No rows at all, no labels, and columns whose names the stages use themselves."""
    path, docs, _ = tables
    full = spark.read.parquet(f"{path}/documents.parquet")
    for name, rows in (("none", full.limit(0)), ("some", full.filter("doc_id < 40 or doc_id >= 1000"))):
        sf = str(tmp_path / name)
        extra = rows.selectExpr("*", "'x' as _key_doc_id", "true as _stay_many", "1 as _row", "2 as row", "3 as node", "'y' as label")
        extra.write.parquet(f"{sf}/documents.parquet")
        spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{sf}/labels.parquet")
        now = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, now, sf)
            assert after.schema == now.schema
            now = spark.createDataFrame(after.collect(), now.schema)
        packed = corpus_pipeline.run(spark, sf)
        assert packed.select("doc_id").distinct().count() == now.count() and (name == "none") == (now.count() == 0)
