import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm.quality import accepted, fit, scored, statistics, train


def good(r):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(r.randint(5, 80))).capitalize() + "."


def junk(r):
    return " ".join(w.upper() + "!!" for w in good(r).split())


@pytest.fixture
def corpus(spark, docs):
    r = random.Random(5)
    kinds = [i % 4 != 0 for i in range(800)]
    rows = [(i, good(r) if k else junk(r)) for i, k in enumerate(kinds)]
    labels = spark.createDataFrame([(i, int(k), 0) for i, k in enumerate(kinds) if i % 2 or not k], "doc_id long, quality int, toxic int")
    return docs(rows), labels, kinds


def test_held_out_documents_are_told_apart(corpus):
    df, labels, kinds = corpus
    got = scored(df, fit(df, labels, trees=30)).collect()
    assert len(got) == 800 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean([r["predicted"] == kinds[r["doc_id"]] for r in held]) > 0.98


def test_rejected_documents_go_and_columns_stay(corpus):
    df, labels, kinds = corpus
    kept = accepted(df, fit(df, labels, trees=30))
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert np.mean([(i in ids) == k for i, k in enumerate(kinds)]) > 0.98


def test_learning_ignores_held_out_and_null_labels(spark, corpus):
    df, labels, _ = corpus
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0 THEN 1 - quality ELSE quality END AS quality")
    nulls = spark.createDataFrame([(None, 1), (1, None), (3, None)], "doc_id long, quality int")
    a, b = fit(df, labels.select("doc_id", "quality"), trees=10), fit(df, flipped.union(nulls), trees=10)
    assert (a.value == b.value).all() and (a.feature == b.feature).all()


def test_without_labels_or_texts(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    df = docs([(1, None), (2, ""), (None, "abc"), (4, " \n "), (5, "x" * 400_000), (5, "x")])
    got = scored(df, fit(df, none)).collect()
    assert len(got) == 6 and all(r["score"] == 0.5 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert scored(docs([]), fit(docs([]), none)).count() == 0 and accepted(df, fit(df, none)).count() == 6


def test_the_trees_walk_as_they_were_grown():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = train(x, y, trees=40, depth=3)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97

    def walk(row, node):
        while model.feature[node] >= 0:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        return model.value[node]

    margins = [model.base + sum(walk(r, root) for root in model.roots) for r in x[:50]]
    assert np.allclose(margins, model.margin(x[:50]))


def test_statistics_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["One two. Three!", None, "", "AAA BBB ### 12", "a\nb\nc", "é è à"]
    together = statistics(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(statistics(pa.array([t], pa.string()))[0], together[k])
    assert np.isfinite(together).all() and (together[1] == together[2]).all()
