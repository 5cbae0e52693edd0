import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm.ranking import spread_rank
from gridloom.llm.storage import flag_probable, materialise, probably_in
from gridloom.llm.text import Words, by_bytes, gathered, joined, sliding_min


def test_the_prefilter_loses_no_row_and_drops_most(spark):
    keys = spark.range(0, 2000).select((F.col("id") * 7).alias("k"))
    rows = spark.range(0, 20_000)
    got = {r["id"] for r in probably_in(rows, "id", keys, "k").collect()}
    wanted = {7 * k for k in range(2000) if 7 * k < 20_000}
    assert wanted <= got and len(got - wanted) < 200
    flagged = flag_probable(rows, "id", keys, "k", bits=8)  # saturated: all rows pass
    assert flagged.count() == 20_000 and flagged.where("_probable").count() == 20_000
    assert probably_in(rows, "id", keys.limit(0), "k").count() == 0


def test_ranks_are_dense_within_hot_groups(spark):
    rows = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.xxhash64("id").alias("o"), "id")
    got = spread_rank(rows, ["g"], "o", ["id"]).collect()
    for g in (0, 1):
        mine = sorted((r["o"], r["rank"]) for r in got if r["g"] == g)
        assert [k for _, k in mine] == list(range(len(mine)))


def test_tables_are_written_once(spark):
    df = materialise(spark.range(10).withColumn("x", F.rand()), "test")
    assert df.collect() == df.collect()


def test_words_are_those_of_the_pattern():
    texts = ["a b", None, "", " \n", "é\x0b\x0cx\r\ny z", "one", "a" * 100, "\x1ca \x1d"]
    words = Words(pa.array(texts))
    got = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert got == ["a", "b", "é", "x", "y z", "one", "a" * 100, "\x1ca", "\x1d"]
    assert words.counts().tolist() == [2, 0, 0, 0, 3, 1, 1, 2]
    part = Words(pa.array(["skip", *texts]).slice(1, 5))
    assert part.counts().tolist() == [2, 0, 0, 0, 3] and (part.hashes() == words.hashes()[:5]).all()
    assert len(Words(pa.array([], pa.string())).hashes()) == 0


def test_hashes_see_every_byte_and_their_order():
    words = [f"w{k}" for k in range(500)] + ["x" * k for k in range(1, 60)] + ["x" * k + "y" for k in range(60)] + ["ab", "ba"]
    h = Words(pa.array([" ".join(words)])).hashes()
    assert len(set(h.tolist())) == len(set(words))
    pairs = joined(h, 2)
    assert len(set(pairs.tolist())) == len(pairs) and len(joined(h[:3], 5)) == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 26, 50])
def test_windows_are_hashed_and_minimised_alike_wherever_they_stand(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 2**63, 200).astype(np.uint64)
    assert (joined(np.concatenate([h[:20], h]), n)[20:] == joined(h, n)).all()
    x = rng.integers(0, 1000, 200)
    assert (sliding_min(x, n) == [x[k : k + n].min() for k in range(200 - n + 1)]).all()


def test_slices_hold_whole_rows_in_order():
    batches = [pa.record_batch({"k": [k], "text": ["x" * size]}) for k, size in enumerate([5, 0, 50, 3, 3, 100, 1])]
    for most in (1, 10, 1000):
        got = [b.column("k").to_pylist() for b in gathered(iter(batches), "text", most)]
        assert [k for part in got for k in part] == list(range(7))
    whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    assert [b.num_rows for b in by_bytes(whole, "text", 10)] == [2, 1, 2, 1, 1]
