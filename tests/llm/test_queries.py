import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import queries, quality
from gridloom.llm.near_dedup import edit_distance

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.execute(queries.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_there_is_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def clean(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_every_stage_of_the_pipeline_takes_effect(spark):
    """Each stage against a plain version of what it must do to its input."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "source mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.storage.materialise(stage(spark, kept[-1], SF), "test"))
        assert kept[-1].columns == columns
    pandas = [k.toPandas() for k in kept]

    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality.scored(docs, model).where("predicted = 1").collect()}
    assert set(pandas[1]["doc_id"]) == good

    first = {}
    for i, t in sorted(zip(pandas[1]["doc_id"], pandas[1]["text"], strict=True)):
        first.setdefault(clean(t), i)
    assert sorted(pandas[2]["doc_id"]) == sorted(first.values())

    code = {}
    words = {i: np.array([code.setdefault(w, len(code) + 1) for w in clean(t).split()], np.uint64) for i, t in zip(pandas[2]["doc_id"], pandas[2]["text"], strict=True)}
    root = {i: i for i in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(words)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            longer = max(len(words[a]), len(words[b]))
            if min(len(words[a]), len(words[b])) >= 5 and edit_distance(words[a], words[b], int(0.2 * longer + 1e-9)) is not None:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(pandas[3]["doc_id"]) == [i for i in ids if find(i) == i]

    size = {i: len(clean(t).split()) for i, t in zip(pandas[3]["doc_id"], pandas[3]["text"], strict=True)}
    times = pandas[4]["doc_id"].value_counts()
    assert times.max() <= 3 and set(times.index) <= set(size)
    taken = sum(size[i] * n for i, n in times.items())
    assert abs(taken - sum(size.values())) <= 0.02 * sum(size.values())

    pieces = corpus_pipeline.pack_sequences(spark, kept[4], SF).toPandas()
    assert (pieces.groupby(["doc_id"])["piece"].apply(lambda p: (p == 0).sum()).reindex(times.index) == times).all()
    filled = pieces.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 2048 and len(filled) <= 1.05 * -(-int(filled.sum()) // 2048) + 1
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
    assert len(corpus_pipeline.run(spark, SF).columns) == 7
