import hashlib
import random
import re

from pyspark.sql import functions as F

from gridloom.llm.exact_dedup import deduplicated, exact_groups, sha256


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check(df, rows, **settings):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    got = sorted(tuple(r) for r in exact_groups(df, **settings).collect())
    want = sorted((i, min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)
    assert got == want
    assert sorted(r["doc_id"] for r in deduplicated(df, **settings).collect()) == sorted(min(g) for g in groups.values())


def corpus():
    r = random.Random(1)
    texts = ["", None, " ", "a b", "a  b", "a\n\tb", " a b", "a b", "A b", "x" * 300_000, "x" * 299_999 + "y"] + [f"text {k}" for k in range(40)]
    return list(enumerate(r.choice(texts) for _ in range(400)))


def test_equals_brute_force(docs):
    rows = corpus()
    check(docs(rows).repartition(7), rows)


def test_digests_that_collide_do_not_merge_texts(docs):
    rows = corpus()
    check(docs(rows).repartition(5), rows, digest=lambda c: sha256(F.substring(c, 1, 1)))


def test_texts_of_one_key_are_told_apart(docs):
    """Digest and checksum of one value: only the texts of one length tell their rows apart."""
    rows = corpus() + [(1000 + k, t) for k, t in enumerate(["ab", "cd", "ab", "ef", "c\td", "c d"])]
    check(docs(rows).repartition(5), rows, digest=lambda c: sha256(F.lit("")), check=lambda c: F.lit(7).cast("long"))
    kept = deduplicated(docs(rows), digest=lambda c: sha256(F.lit("")), check=lambda c: F.lit(7).cast("long"))
    assert kept.columns == docs(rows).columns


def test_a_hot_text_is_split(spark, docs):
    """With broadcasts off, the join of rows and classes deals out a text that half of all rows have."""
    rows = [(i, "same text" if i % 2 else f"own {i}") for i in range(6000)]
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = exact_groups(docs(rows).repartition(16))
        assert len(got.collect()) == 6000
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_text_and_few_salts(docs):
    rows = [(i, "same  text" if i % 3 else f"own {i}") for i in range(600)]
    check(docs(rows).repartition(16), rows, salts=2)


def test_null_and_repeated_ids(docs):
    df = docs([(None, "a"), (2, "a"), (2, "a"), (None, "b"), (None, "b"), (None, "c")])
    got = sorted(((r["doc_id"] or 0), (r["keep_id"] or 0), r["group_size"], r["kept"]) for r in exact_groups(df).collect())
    assert got == [(0, 0, 1, True), (0, 0, 2, True), (0, 0, 2, True), (0, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True)]
    kept = deduplicated(df)
    assert kept.columns == df.columns and sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect()) == [(0, "b"), (0, "c"), (2, "a")]
    assert exact_groups(docs([])).count() == 0 and deduplicated(docs([])).count() == 0
