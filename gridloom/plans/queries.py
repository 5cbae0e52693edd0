"""Queries of the collections and the SQL that each must equal.

All run over whole tables.  Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import session
from gridloom.algorithms import glm, kmeans, pagerank, random_forest
from gridloom.algorithms.glm import Control
from gridloom.algorithms.kmeans import assigned, finite_rows, lloyd
from gridloom.grid import Grid
from gridloom.index import RID
from gridloom.objects import DArray, DFrame, DList, SparseArray
from gridloom.operators import aggregates as agg
from gridloom.operators import binding, dmapply, elementwise, head, index, map_cells, map_columns, map_items, matmul, repartition, reverse, split, tail
from gridloom.operators.partitioning import block_sizes
from gridloom.sources import darray, dlist, from_dataframe, sparse_from_dataframe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that it must equal."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.use_session(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unordered(df: DataFrame, columns: list[str]) -> DFrame:
    """A frame whose row order nothing asks for; the row number is pruned from the plan."""
    rows = df.select(F.monotonically_increasing_id().alias(RID), *columns)
    return DFrame(rows, Grid((df.count(),), (len(columns),)), columns)


_ITEMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_ORDER = ["o_orderkey", "o_custkey", "o_totalprice"]


def _items(spark, d) -> DFrame:
    return _unordered(_table(spark, d, "lineitem"), _ITEMS)


def _holes(spark, d) -> DFrame:
    """Discounts of 0 are missing."""
    rows = _table(spark, d, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("a"), "l_tax")
    return _unordered(rows, ["a", "l_tax"])


def _orders(spark, d, psize=(1000, 2), columns=_ORDER, kind="dframe"):
    rows = _table(spark, d, "orders").select("o_orderkey", *[c for c in columns if c != "o_orderkey"])
    return from_dataframe(rows, "o_orderkey", psize, columns, kind)


def _price_list(spark, d) -> DList:
    x = _orders(spark, d, None, ["o_totalprice"])
    return DList(x.df.select(F.col(RID).alias("idx"), F.col("o_totalprice").alias("value")), list(Grid.even((x.dim[0], 1), (7, 1)).rows))


def _round(df: DataFrame, n: int = 4, column: str = "value") -> DataFrame:
    return df.withColumn(column, F.round(column, n))


def _per_column(columns: list[str], form: str, table: str) -> str:
    return " UNION ALL ".join(f"SELECT {j}::BIGINT AS j, '{c}' AS name, {form.format(c=c)} AS value FROM {table}" for j, c in enumerate(columns, 1))


_HOLES = "(SELECT nullif(l_discount, 0) AS a, l_tax FROM lineitem)"
_NUMBERED = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rid FROM orders)"


@query(_per_column(_ITEMS, "round(sum({c}), 2)", "lineitem"))
def dframe_colsums(spark, d):
    return _round(agg.col_sums(_items(spark, d)), 2)


@query(_per_column(_ITEMS, "round(sum({c}) / count(*), 6)", "lineitem"))
def dframe_colmeans(spark, d):
    return _round(agg.col_means(_items(spark, d)), 6)


@query(_per_column(["a", "l_tax"], "round(coalesce(sum({c}), 0) / count(*), 6)", _HOLES))
def colmeans_narm(spark, d):
    return _round(agg.col_means(_holes(spark, d), na_rm=True), 6)


@query(_per_column(["a", "l_tax"], "round(CASE WHEN count({c}) = count(*) THEN sum({c}) END, 4)", _HOLES))
def colsums_na_propagates(spark, d):
    return _round(agg.col_sums(_holes(spark, d)))


@query(_per_column(_ITEMS, "round(median({c}), 4)", "lineitem"))
def colmedians(spark, d):
    return _round(agg.col_medians(_items(spark, d)))


@query(f"SELECT rid AS __rid, round(o_orderkey + o_custkey + o_totalprice, 4) AS value FROM {_NUMBERED}")
def rowsums(spark, d):
    return _round(agg.row_sums(_orders(spark, d)))


@query(f"SELECT rid AS __rid, round((o_orderkey + o_custkey + o_totalprice) / 3, 4) AS value FROM {_NUMBERED}")
def rowmeans(spark, d):
    return _round(agg.row_means(_orders(spark, d)))


@query(f"SELECT rid AS __rid, round((coalesce(nullif(o_custkey % 5, 0), 0) + o_totalprice) / 2, 4) AS value FROM {_NUMBERED}")
def rowmeans_narm(spark, d):
    x = _orders(spark, d)
    y = DFrame(x.df.select(RID, F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("a"), "o_totalprice"), x.grid, ["a", "o_totalprice"])
    return _round(agg.row_means(y, na_rm=True))


@query("SELECT round(sum(l_quantity + l_extendedprice + l_discount + l_tax), 2) AS value FROM lineitem")
def grand_sum(spark, d):
    return _round(agg.total(_items(spark, d)), 2)


@query("SELECT round(sum(l_quantity + l_extendedprice + l_discount + l_tax) / (count(*) * 4), 6) AS value FROM lineitem")
def grand_mean(spark, d):
    return _round(agg.mean(_items(spark, d)), 6)


@query("SELECT round((SELECT sum(l_quantity + l_tax) FROM lineitem) + (SELECT sum(o_totalprice) FROM orders), 2) AS value")
def variadic_sum(spark, d):
    a = _unordered(_table(spark, d, "lineitem"), ["l_quantity", "l_tax"])
    b = _unordered(_table(spark, d, "orders"), ["o_totalprice"])
    return _round(agg.total(a, b), 2)


@query("SELECT greatest(max(l_quantity), max(l_extendedprice), max(l_discount), max(l_tax)) AS value FROM lineitem")
def dobj_max(spark, d):
    return agg.largest(_items(spark, d))


@query("SELECT least(min(l_quantity), min(l_extendedprice), min(l_discount), min(l_tax)) + 0.0 AS value FROM lineitem")
def dobj_min(spark, d):
    return agg.smallest(_items(spark, d)).select((F.col("value") + 0.0).alias("value"))  # minus zero is zero


@query("SELECT CASE WHEN count(a) = count(*) THEN max(a) END AS value FROM (SELECT nullif(l_discount, 0) AS a FROM lineitem)")
def max_na_propagates(spark, d):
    return agg.largest(_unordered(_holes(spark, d).df, ["a"]))


@query(f"SELECT rid AS __rid, o_orderkey, o_custkey, o_totalprice FROM {_NUMBERED} WHERE rid <= 10")
def head_n(spark, d):
    return head(_orders(spark, d), 10).df


@query(f"SELECT rid - (SELECT count(*) FROM orders) + 10 AS __rid, o_orderkey, o_custkey, o_totalprice FROM {_NUMBERED} WHERE rid > (SELECT count(*) FROM orders) - 10")
def tail_n(spark, d):
    return tail(_orders(spark, d), 10).df


@query(f"SELECT rid AS __rid, o_orderkey, o_custkey, o_totalprice FROM {_NUMBERED} WHERE rid < 0")
def head_zero(spark, d):
    return head(_orders(spark, d), 0).df


@query(f"SELECT p.pos::BIGINT AS pos, o_totalprice, o_orderkey FROM (VALUES (1, 7), (2, 3), (3, 100)) AS p(pos, k) JOIN {_NUMBERED} o ON o.rid = p.k")
def index_2d(spark, d):
    return index(_orders(spark, d), [7, 3, 100], [3, 1])


@query(f"SELECT p.pos::BIGINT AS pos, o_totalprice, o_custkey, o_totalprice AS \"o_totalprice.1\" FROM (VALUES (1, 7), (2, 3), (3, 3), (4, 100)) AS p(pos, k) JOIN {_NUMBERED} o ON o.rid = p.k")
def index_dup_order(spark, d):
    return index(_orders(spark, d), [7, 3, 3, 100], [3, 2, 3])


@query(f"SELECT p.pos::BIGINT AS pos, p.k::BIGINT AS idx, o_totalprice AS value FROM (VALUES (1, 90), (2, 2), (3, 2)) AS p(pos, k) JOIN {_NUMBERED} o ON o.rid = p.k")
def index_1d(spark, d):
    return index(_price_list(spark, d), [90, 2, 2])


@query(f"SELECT 1::BIGINT AS pos, 42::BIGINT AS idx, o_totalprice AS value FROM {_NUMBERED} WHERE rid = 42")
def index2_elem(spark, d):
    return index(_price_list(spark, d), 42)


@query(f"SELECT rid AS __rid, o_totalprice FROM {_NUMBERED}")
def dollar_name(spark, d):
    return _orders(spark, d).by_name("o_totalprice")


@query("SELECT p.pos::BIGINT AS pos, p.name, p.value FROM (VALUES (2, 'b', 20.0::DOUBLE), (4, 'b', 40.0::DOUBLE)) AS p(pos, name, value)")
def list_names(spark, d):
    x = dlist(10.0, 20.0, 30.0, 40.0).with_names(["a", "b", "c", "b"])
    return x.df.where("name = 'b'").select(F.col("idx").alias("pos"), "name", "value")


@query(f"SELECT rid AS __rid, 'r' || rid AS __rowname, o_orderkey AS k, o_custkey AS c, o_totalprice AS p FROM {_NUMBERED} WHERE rid <= 5")
def dim_names(spark, d):
    x = head(_orders(spark, d), 5)
    return x.with_rownames([f"r{k}" for k in range(1, 6)]).with_colnames(["k", "c", "p"]).df


@query("SELECT ((rid - 1) // 1000 + 1)::INT AS block, count(*) AS n FROM (SELECT row_number() OVER () AS rid FROM orders) GROUP BY 1")
def parts_sizes(spark, d):
    return block_sizes(_orders(spark, d))


@query(f"SELECT rid - 1000 AS __rid, o_orderkey, o_custkey FROM {_NUMBERED} WHERE rid BETWEEN 1001 AND 2000")
def part_k(spark, d):
    x = _orders(spark, d, (1000, 2))
    return x.part(x.nparts[1] + 1).df


@query(f"SELECT rid - 1000 AS __rid, o_totalprice FROM {_NUMBERED} WHERE rid BETWEEN 1001 AND 2000")
def part_right_column(spark, d):
    return _orders(spark, d, (1000, 2)).part(4).df


@query("SELECT ((rid - 1) // 300 + 1)::INT AS block, count(*) AS n FROM (SELECT row_number() OVER () AS rid FROM orders) GROUP BY 1")
def repartition_sizes(spark, d):
    x = _orders(spark, d, (1000, 2))
    return block_sizes(repartition(x, darray(dim=x.dim, psize=(300, 3))))


@query("SELECT (CASE WHEN rid <= (n % 7) * (n // 7 + 1) THEN (rid - 1) // (n // 7 + 1) ELSE n % 7 + (rid - 1 - (n % 7) * (n // 7 + 1)) // (n // 7) END + 1)::INT AS block, count(*) AS n FROM (SELECT row_number() OVER () AS rid, count(*) OVER () AS n FROM orders) GROUP BY 1")
def split_even_sizes(spark, d):
    return block_sizes(_price_list(spark, d))


@query('SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) AS "group", count(*) AS n FROM orders GROUP BY 1')
def split_by_column(spark, d):
    x = _unordered(_table(spark, d, "orders"), ["o_orderpriority"])
    return split(x, "o_orderpriority").groupBy("o_orderpriority", "group").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT rid AS idx, round(o_totalprice * 2 + 1, 4) AS value FROM {_NUMBERED}")
def elem_map(spark, d):
    return _round(map_items(lambda v: v * 2 + 1, _price_list(spark, d)).df)


@query(f"SELECT a.rid AS idx, round(a.o_totalprice + b.o_totalprice, 4) AS value FROM {_NUMBERED} a JOIN {_NUMBERED} b ON b.rid = (SELECT count(*) FROM orders) + 1 - a.rid")
def elem_zip(spark, d):
    x = _price_list(spark, d)
    return _round(map_items(lambda a, b: a + b, x, reverse(x)).df)


@query("WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS rid, n_nationkey AS k FROM nation) SELECT rid AS idx, (k + 100.0)::DOUBLE AS value FROM n")
def elem_morearg(spark, d):
    x = from_dataframe(_table(spark, d, "nation").select("n_nationkey"), "n_nationkey")
    keys = DList(x.df.select(F.col(RID).alias("idx"), F.col("n_nationkey").cast("double").alias("value")), [x.dim[0]])
    got = dmapply(lambda v, z: v + z[0], keys, more_args={"z": dlist(100.0)}, nparts=5)
    return _loaded(got, "double")


def _loaded(x: DList, kind: str) -> DataFrame:
    """The pickled items of a list of numbers as a column."""
    import pickle

    def run(batches):
        for b in batches:
            b["value"] = [pickle.loads(v) for v in b["value"]]
            yield b

    return x.df.mapInPandas(run, f"idx long, value {kind}")


@query(_per_column(_ITEMS, "round(max({c}) - min({c}), 4)", "lineitem"))
def col_map(spark, d):
    return _round(map_columns(lambda c: F.max(c) - F.min(c), _items(spark, d)))


@query("WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_size::DOUBLE AS a, p_retailprice AS b, (SELECT count(*) FROM part) AS n FROM part) SELECT i AS idx, round(a * 10, 4) AS value FROM p UNION ALL SELECT n + i, round(b * 10, 4) FROM p")
def cell_map_colmajor(spark, d):
    x = from_dataframe(_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", None, ["p_size", "p_retailprice"], "darray")
    return _round(map_cells(lambda v: v * 10, x).df)


@query(f"SELECT a.rid AS idx, round(a.o_totalprice - 2 * b.o_totalprice, 4) AS value FROM {_NUMBERED} a JOIN {_NUMBERED} b ON b.rid = (SELECT count(*) FROM orders) + 1 - a.rid")
def dmapply_zip(spark, d):
    """Any function of the items at each place of two lists."""
    x = _price_list(spark, d)
    return _round(_loaded(dmapply(lambda a, b: a - 2 * b, x, reverse(x)), "double"))


@query(f"SELECT j AS idx, value FROM ({_per_column(_ORDER, 'round(max({c}) - min({c}) + count(*), 4)::DOUBLE', 'orders')})")
def dmapply_columns(spark, d):
    """Any function of each column of a frame."""
    return _round(_loaded(dmapply(lambda c: float(max(c) - min(c) + len(c)), _orders(spark, d), nparts=3), "double"))


@query("WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_size::DOUBLE AS a, p_retailprice AS b, (SELECT count(*) FROM part) AS n FROM part) SELECT i AS idx, round(a * 10 - 1, 4) AS value FROM p UNION ALL SELECT n + i, round(b * 10 - 1, 4) FROM p")
def dmapply_cells(spark, d):
    """Any function of each cell of an array, in column-major order."""
    return _round(_loaded(dmapply(lambda v: v * 10 - 1, _part_array(spark, d)), "double"))


@query("WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS rid, n_nationkey AS k FROM nation) SELECT (rid - 1) // 5 + 1 AS idx, round(sum(k) + 1000 * ((rid - 1) // 5 + 1) + 0.5, 4)::DOUBLE AS value FROM n GROUP BY (rid - 1) // 5")
def dmapply_multimodal(spark, d):
    """Partitions of an array, items of a list and a local vector side by side."""
    x = from_dataframe(_table(spark, d, "nation").select("n_nationkey"), "n_nationkey", (5, 1), ["n_nationkey"], "darray")
    parts = x.parts()
    numbers = dlist(*[1000.0 * k for k in range(1, len(parts) + 1)])
    return _round(_loaded(dmapply(lambda block, k, half: float(block.sum() + k + half), parts, numbers, [0.5] * len(parts)), "double"))


@query(f"SELECT ((rid - 1) // 1000 + 1)::BIGINT AS idx, round(sum(o_totalprice), 2) AS value FROM {_NUMBERED} GROUP BY 1")
def part_map(spark, d):
    x = _orders(spark, d, (1000, 1), ["o_totalprice"], "darray")
    return _round(_loaded(dmapply(lambda block: float(block.sum()), x.parts()), "double"), 2)


@query(f"SELECT ((rid - 1) // 1000 + 1)::BIGINT AS idx, round(sum(o_totalprice) - sum(o_custkey), 2) AS value FROM {_NUMBERED} GROUP BY 1")
def part_zip(spark, d):
    x = _orders(spark, d, (1000, 1), ["o_totalprice", "o_custkey"], "darray")
    a, b = x.parts(range(1, x.total_parts + 1, 2)), x.parts(range(2, x.total_parts + 1, 2))
    return _round(_loaded(dmapply(lambda p, q: float(p.sum() - q.sum()), a, b), "double"), 2)


@query(f"SELECT k AS idx, round(coalesce((SELECT sum(o_totalprice) FROM {_NUMBERED} WHERE k = 1 AND rid <= 500 OR k = 3 AND rid > 250 AND rid <= 500), 0), 2) AS value FROM (VALUES (1::BIGINT), (2::BIGINT), (3::BIGINT)) AS t(k)")
def part_grouped(spark, d):
    x = _orders(spark, d, (250, 1), ["o_totalprice"], "darray")
    groups = [x.parts([1, 2]), [], x.parts([2])]
    return _round(_loaded(dmapply(lambda blocks: float(sum(b.sum() for b in blocks)), groups), "double"), 2)


@query(f"SELECT ((rid - 1) // 1000 + 1)::BIGINT AS idx, (count(*) + 10 * ((rid - 1) // 1000 + 1) - 3)::DOUBLE AS value FROM {_NUMBERED} GROUP BY (rid - 1) // 1000")
def part_vector_mix(spark, d):
    x = _orders(spark, d, (1000, 1), ["o_totalprice"], "darray")
    return _loaded(dmapply(lambda block, y, z: float(len(block) + y - z), x.parts(), [10 * k for k in range(1, x.total_parts + 1)], more_args={"z": 3}), "double")


@query("SELECT vec_id * 64 + pos AS idx, value::DOUBLE AS value FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS pos FROM embeddings)")
def flatmap_c(spark, d):
    x = from_dataframe(_table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    vectors = DList(x.df.select(F.col(RID).alias("idx"), F.col("embedding").alias("value")), [x.dim[0]])
    return _loaded(dmapply(lambda v: [float(e) for e in v], vectors, combine="c"), "double")


@query(f"SELECT s.k AS __rid, round(max(CASE WHEN b = 0 THEN v END), 2) AS c1, round(max(CASE WHEN b = 1 THEN v END), 2) AS c2 FROM (SELECT (rid - 1) // ceil((SELECT count(*) FROM orders) / 2)::BIGINT AS b, sum(o_totalprice) AS s, max(o_totalprice) AS m, min(o_totalprice) AS l FROM {_NUMBERED} GROUP BY 1), LATERAL (VALUES (1::BIGINT, s), (2::BIGINT, m), (3::BIGINT, l)) AS s(k, v) GROUP BY s.k")
def simplify_columns(spark, d):
    n = _table(spark, d, "orders").count()
    x = _orders(spark, d, (-(-n // 2), 1), ["o_totalprice"], "darray")
    got = dmapply(lambda b: np.array([b.sum(), b.max(), b.min()]), x.parts(), output_type="darray", nparts=1)
    return got.df.select(RID, F.round("c1", 2).alias("c1"), F.round("c2", 2).alias("c2"))


@query("SELECT row_number() OVER (ORDER BY src, k) AS __rid, round(v, 4) AS c1 FROM (SELECT 1 AS src, o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT 2, c_custkey, c_acctbal FROM customer)")
def rbind_offset(spark, d):
    a = _orders(spark, d, None, ["o_totalprice"], "darray")
    b = from_dataframe(_table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", None, ["c_acctbal"], "darray")
    return _round(binding.rbind(a, b).df, 4, "c1")


@query(f"SELECT a.rid AS __rid, o_totalprice, (a.rid * 2)::DOUBLE AS twice FROM {_NUMBERED} a")
def cbind_positional(spark, d):
    a = _orders(spark, d, None, ["o_totalprice"])
    b = DFrame(a.df.select(RID, (F.col(RID) * 2).cast("double").alias("twice")), a.grid, ["twice"])
    return binding.cbind(a, b).df


@query("SELECT row_number() OVER (ORDER BY src, k) AS __rid, v AS n_regionkey FROM (SELECT 1 AS src, n_nationkey AS k, n_regionkey::DOUBLE AS v FROM nation UNION ALL SELECT 2, r_regionkey, r_regionkey::DOUBLE FROM region)")
def rbind_type_promote(spark, d):
    a = from_dataframe(_table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("double").alias("n_regionkey")), "n_nationkey", None, ["n_regionkey"])
    b = from_dataframe(_table(spark, d, "region").select("r_regionkey"), "r_regionkey", None, ["r_regionkey"], "darray")
    return binding.rbind(a, b).df


@query("SELECT DISTINCT l_returnflag AS value FROM lineitem")
def unique_values(spark, d):
    x = _table(spark, d, "lineitem")
    return agg.unique(DList(x.select(F.monotonically_increasing_id().alias("idx"), F.col("l_returnflag").alias("value")), [1]))


@query("SELECT DISTINCT l_discount AS value FROM lineitem UNION SELECT DISTINCT l_tax FROM lineitem")
def unique_cells(spark, d):
    x = _unordered(_table(spark, d, "lineitem"), ["l_discount", "l_tax"])
    return agg.unique(DArray(x.df, x.grid, x.columns))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def unique_rows(spark, d):
    return agg.unique(_unordered(_table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]))


@query("SELECT (SELECT count(*) FROM nation) + 1 - row_number() OVER (ORDER BY n_nationkey) AS idx, n_name AS value FROM nation")
def rev_list(spark, d):
    x = from_dataframe(_table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return reverse(DList(x.df.select(F.col(RID).alias("idx"), F.col("n_name").alias("value")), [x.dim[0]])).df


_BREAKS = [float("-inf"), *np.arange(-16.5, 17.0, 3.0).tolist(), float("inf")]
_EDGES = ", ".join(f"({k}, '{a}'::DOUBLE, '{b}'::DOUBLE)" for k, (a, b) in enumerate(zip(_BREAKS[:-1], _BREAKS[1:], strict=True), 1))


@query(f"SELECT b.bin, b.low, b.high, count(l.v) AS n FROM (VALUES {_EDGES}) AS b(bin, low, high) LEFT JOIN (SELECT l_quantity - 25 AS v FROM lineitem) l ON l.v > b.low AND l.v <= b.high GROUP BY 1, 2, 3")
def bin_histogram(spark, d):
    return agg.bin_counts(_table(spark, d, "lineitem"), F.col("l_quantity") - 25, _BREAKS)


@query(f"SELECT b.bin, b.low, b.high, count(l.v) AS n FROM (VALUES {_EDGES}) AS b(bin, low, high) LEFT JOIN (SELECT l_quantity - l_discount * 100 AS v FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 AND l_discount * 100 BETWEEN 1 AND 9) l ON l.v > b.low AND l.v <= b.high GROUP BY 1, 2, 3")
def filter_difference_histogram(spark, d):
    rows = _table(spark, d, "lineitem").where("l_quantity BETWEEN 5 AND 40 AND l_discount * 100 BETWEEN 1 AND 9")
    return agg.bin_counts(rows, F.col("l_quantity") - F.col("l_discount") * 100, _BREAKS)


@query(f"SELECT rid AS __rid, round(o_totalprice - o_custkey, 4) AS c1 FROM {_NUMBERED}")
def elementwise_minus(spark, d):
    x = _orders(spark, d, None, ["o_totalprice", "o_custkey"], "darray")
    half = lambda c: DArray(x.df.select(RID, F.col(c).alias("c1")), Grid(x.grid.rows, (1,)), ["c1"])
    return _round(elementwise(lambda a, b: a - b, half("c1"), half("c2")).df, 4, "c1")


def _priorities(spark, d) -> SparseArray:
    """How many orders a customer (row) has of a priority (column): many have none."""
    orders = _table(spark, d, "orders")
    names = [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    n = _table(spark, d, "customer").count()
    j = F.array_position(F.array(*map(F.lit, names)), F.col("o_orderpriority"))
    return sparse_from_dataframe(orders.select((F.col("o_custkey") + 1).alias("i"), j.alias("j"), F.lit(1.0).alias("v")), (n, len(names)), (min(500, n), 2))


_CELLS = "(SELECT (o_custkey + 1)::BIGINT AS i, j, count(*)::DOUBLE AS v FROM orders JOIN (SELECT o_orderpriority AS name, row_number() OVER (ORDER BY o_orderpriority) AS j FROM (SELECT DISTINCT o_orderpriority FROM orders)) ON name = o_orderpriority GROUP BY 1, 2)"
_CELL_COUNT = "(SELECT count(*) FROM customer) * (SELECT count(DISTINCT o_orderpriority) FROM orders)"


@query(f"SELECT c_custkey + 1::BIGINT AS __rid, coalesce(sum(v), 0.0)::DOUBLE AS value FROM customer LEFT JOIN {_CELLS} ON i = c_custkey + 1 GROUP BY c_custkey")
def sparse_rowsums(spark, d):
    return agg.row_sums(_priorities(spark, d))


@query(f"SELECT j, 'c' || j AS name, sum(v) AS value FROM {_CELLS} GROUP BY j")
def sparse_colsums(spark, d):
    return agg.col_sums(_priorities(spark, d))


@query(f"SELECT CASE WHEN count(*) < {_CELL_COUNT} THEN least(min(v), 0) ELSE min(v) END AS value FROM {_CELLS}")
def sparse_min_implicit_zero(spark, d):
    return agg.smallest(_priorities(spark, d))


@query(f"SELECT CASE WHEN count(*) < {_CELL_COUNT} THEN greatest(max(-v), 0) ELSE max(-v) END AS value FROM {_CELLS}")
def sparse_max_implicit_zero(spark, d):
    x = _priorities(spark, d)
    return agg.largest(SparseArray(x.df.withColumn("v", -F.col("v")), x.grid))


@query(f"SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM {_CELLS} a JOIN {_CELLS} b ON a.i = b.i GROUP BY 1, 2")
def matmul_coo(spark, d):
    x = _priorities(spark, d)
    t = SparseArray(x.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), Grid(x.grid.cols, x.grid.rows))
    return matmul(t, x).df


@query(f"SELECT i, j, v FROM {_CELLS} ORDER BY v DESC, j, i LIMIT 1")
def dwhich_max(spark, d):
    return agg.which_max(_priorities(spark, d))


@query("SELECT rid AS __rid, round(c1, 2) AS c1 FROM (SELECT row_number() OVER (ORDER BY k) AS rid, c1 FROM (SELECT (rid - 1) // 500 AS k, sum(o_totalprice) AS c1 FROM " + _NUMBERED + " GROUP BY 1))")
def dmapply_rbind(spark, d):
    x = _orders(spark, d, (500, 1), ["o_totalprice"], "darray")
    got = dmapply(lambda b: b.sum(axis=0, keepdims=True), x.parts(), output_type="darray", combine="rbind", nparts=(x.total_parts, 1))
    return _round(got.df, 2, "c1")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS __rid, n_name AS name, n_nationkey * 2 + 0.5::DOUBLE AS twice FROM nation")
def dmapply_frame(spark, d):
    import pandas as pd

    x = from_dataframe(_table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", (10, 2), ["n_nationkey", "n_name"])
    got = dmapply(lambda b: pd.DataFrame({"name": b["n_name"], "twice": b["n_nationkey"] * 2 + 0.5}), x.parts(), output_type="dframe", combine="rbind", nparts=(x.total_parts, 1))
    return got.df


_TRADE = "(SELECT c_nationkey + 1 AS i, n_regionkey * 5 + o_custkey % 5 + 1 AS j, count(*)::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


def _trade(spark, d) -> SparseArray:
    """Links between nations: orders of each nation's customers, by region and customer."""
    rows = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = rows.select((F.col("c_nationkey") + 1).alias("i"), (F.col("n_regionkey") * 5 + F.col("o_custkey") % 5 + 1).alias("j"), F.lit(1.0).alias("v"))
    n = _table(spark, d, "nation").count()
    return sparse_from_dataframe(cells, (n, n), (n, n))


def _pagerank_sql(passes: int, weight: str = "v", teleport: str = "1.0 / 25", digits: int = 8) -> str:
    out = f"WITH e AS MATERIALIZED (SELECT i, j, {weight} AS v FROM {_TRADE}), s AS MATERIALIZED (SELECT e.i, j, v / (sum(v) OVER (PARTITION BY e.i)) AS share FROM e), n AS (SELECT n_nationkey + 1 AS id, {teleport} AS t FROM nation), p0 AS (SELECT id, 0.15 AS r FROM n)"
    for k in range(1, passes + 1):
        out += f", u{k} AS (SELECT n.id, 0.85 * coalesce(sum(s.share * p.r), 0) + 0.15 * any_value(n.t) AS r FROM n LEFT JOIN s ON s.j = n.id LEFT JOIN p{k - 1} p ON p.id = s.i GROUP BY n.id), p{k} AS MATERIALIZED (SELECT id, r / (SELECT sum(r) FROM u{k}) AS r FROM u{k})"
    return out + f" SELECT id::BIGINT AS id, round(r, {digits}) AS rank FROM p{passes}"


@query(_pagerank_sql(5))
def pagerank_k(spark, d):
    return _round(pagerank(_trade(spark, d), niter=5, eps=1e-300), 8, "rank")


@query(_pagerank_sql(5, "v * (j % 3 + 1)"))
def pagerank_weighted(spark, d):
    x = _trade(spark, d)
    w = SparseArray(x.df.select("i", "j", (F.col("j") % 3 + 1).cast("double").alias("v")), x.grid)
    return _round(pagerank(x, niter=5, eps=1e-300, weights=w), 8, "rank")


@query(_pagerank_sql(5, teleport="(n_nationkey + 1) / 325.0"))
def pagerank_personalized(spark, d):
    x = _trade(spark, d)
    n = x.dim[0]
    t = SparseArray(spark.range(1, n + 1).select(F.lit(1).cast("long").alias("i"), F.col("id").alias("j"), (F.col("id") / (n * (n + 1) / 2)).alias("v")), Grid((1,), (n,)))
    return _round(pagerank(x, niter=5, eps=1e-300, personalized=t), 8, "rank")


@query(_pagerank_sql(40, digits=4))
def pagerank_eps(spark, d):
    """Stops by itself, at ranks that more passes do not change."""
    return _round(pagerank(_trade(spark, d), niter=100, eps=1e-7), 4, "rank")


@query(_pagerank_sql(5))
def pagerank_dense(spark, d):
    x = _trade(spark, d)
    n = x.dim[0]
    rows = spark.range(1, n + 1).join(x.df.withColumnRenamed("i", "id"), "id", "left").groupBy("id").agg(*(F.coalesce(F.sum(F.when(F.col("j") == j, F.col("v"))), F.lit(0.0)).alias(f"c{j}") for j in range(1, n + 1)))
    dense = from_dataframe(rows, "id", (n, 5), [f"c{j}" for j in range(1, n + 1)], "darray")
    return _round(pagerank(dense, niter=5, eps=1e-300), 8, "rank")


_CENTERS = np.array([[5.0, 920.0], [25.0, 950.0], [45.0, 980.0]])
_PARTS = "(SELECT row_number() OVER (ORDER BY p_partkey) AS rid, p_size::DOUBLE AS a, p_retailprice AS b FROM part)"


def _part_array(spark, d) -> DArray:
    return from_dataframe(_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", None, ["p_size", "p_retailprice"], "darray")


def _kmeans_sql(passes: int) -> str:
    out = f"WITH x AS MATERIALIZED (SELECT * FROM {_PARTS}), c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(_CENTERS, 1)) + ") AS t(k, a, b))"
    for n in range(1, passes + 2):
        out += f", l{n} AS MATERIALIZED (SELECT rid, xa, xb, k AS label, d2 FROM (SELECT x.rid, x.a AS xa, x.b AS xb, c.k, (x.a - c.a) ** 2 + (x.b - c.b) ** 2 AS d2, row_number() OVER (PARTITION BY x.rid ORDER BY (x.a - c.a) ** 2 + (x.b - c.b) ** 2, c.k) AS q FROM x, c{n - 1} c) WHERE q = 1)"
        out += f", c{n} AS MATERIALIZED (SELECT c.k, coalesce(m.a, c.a) AS a, coalesce(m.b, c.b) AS b FROM c{n - 1} c LEFT JOIN (SELECT label, avg(xa) AS a, avg(xb) AS b FROM l{n} GROUP BY label) m ON m.label = c.k)"
    return out


@query(_kmeans_sql(0) + " SELECT rid AS __rid, label, round(d2, 4) AS d2 FROM l1")
def kmeans_assign(spark, d):
    return _round(assigned(_part_array(spark, d), _CENTERS), 4, "d2")


def _centers(spark, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, round(float(a), 6), round(float(b), 6)) for k, (a, b) in enumerate(centers, 1)], "k int, a double, b double")


@query(_kmeans_sql(1) + " SELECT k, round(a, 6) AS a, round(b, 6) AS b FROM c1")
def kmeans_step(spark, d):
    return _centers(spark, lloyd(_part_array(spark, d), _CENTERS, 1)[0])


@query(_kmeans_sql(4) + " SELECT k, round(a, 6) AS a, round(b, 6) AS b FROM c4")
def kmeans_k_iters(spark, d):
    return _centers(spark, lloyd(_part_array(spark, d), _CENTERS, 4)[0])


@query(_kmeans_sql(0) + " SELECT label, round(sum(d2), 2) AS wss, count(*) AS n FROM l1 GROUP BY label")
def kmeans_wss(spark, d):
    return assigned(_part_array(spark, d), _CENTERS).groupBy("label").agg(F.round(F.sum("d2"), 2).alias("wss"), F.count(F.lit(1)).alias("n"))


def _fitted(spark, d):
    return kmeans(_part_array(spark, d), _CENTERS, iter_max=3, complete_model=True)


@query(_kmeans_sql(3) + " SELECT rid AS __rid, label FROM l4")
def kmeans_predict(spark, d):
    """Labels of the rows by a model of three passes."""
    return _fitted(spark, d).predict(_part_array(spark, d))


@query(_kmeans_sql(3) + " SELECT rid AS __rid, round(c.a, 6) AS a, round(c.b, 6) AS b FROM l4 JOIN c3 c ON c.k = l4.label")
def kmeans_fitted(spark, d):
    got = _fitted(spark, d).fitted("centers")
    return got.select(RID, F.round(F.col("center")[0], 6).alias("a"), F.round(F.col("center")[1], 6).alias("b"))


@query(_kmeans_sql(3) + " SELECT label, count(*) AS n, round(sum(d2), 2) AS wss, round((SELECT (var_pop(xa) + var_pop(xb)) * count(*) FROM l4) - (SELECT sum(d2) FROM l4), 1) AS betweenss FROM l4 GROUP BY label")
def kmeans_model(spark, d):
    """What a complete model holds: sums of squares within its clusters and between them."""
    m = _fitted(spark, d)
    labels = m.cluster.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    wss = spark.createDataFrame([(k, round(float(w), 2), round(float(m.betweenss), 1)) for k, w in enumerate(m.withinss, 1)], "label int, wss double, betweenss double")
    return labels.join(wss, "label")


@query()
def kmeans_nstart(spark, d):
    """Of several starts the one with the least sum of squares is kept, and a seed repeats itself."""
    x = _part_array(spark, d)
    one, two, again = (kmeans(x, 3, iter_max=4, nstart=n, complete_model=True, seed=1) for n in (1, 2, 2))
    return spark.createDataFrame([(bool(two.tot_withinss <= one.tot_withinss + 1e-9), bool(np.allclose(two.centers, again.centers)))], "best boolean, same boolean")


@query(f"SELECT round((var_pop(a) + var_pop(b)) * count(*), 2) AS totss FROM {_PARTS}")
def kmeans_totss(spark, d):
    model = kmeans(_part_array(spark, d), _CENTERS, iter_max=30, complete_model=True)
    return spark.createDataFrame([(round(model.totss, 2),)], "totss double")


@query(f"SELECT (rid %11 != 0) AS good, count(*) AS n FROM {_PARTS} GROUP BY 1")
def na_check_rows(spark, d):
    x = _part_array(spark, d)
    holes = F.when(F.col(RID) % 22 == 0, F.lit(None)).when(F.col(RID) % 11 == 0, F.lit(float("nan"))).otherwise(F.col("c1"))
    return finite_rows(DArray(x.df.withColumn("c1", holes), x.grid, x.columns)).groupBy("good").agg(F.count(F.lit(1)).alias("n"))


def _columns(spark, d, y: str, x: str) -> tuple[DArray, DArray]:
    rows = _table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias(RID), F.expr(y).cast("double").alias("y"), F.expr(x).cast("double").alias("x"))
    n = rows.count()
    make = lambda c: DArray(rows.select(RID, F.col(c).alias(c)), Grid((n,), (1,)), [c])
    return make("y"), make("x")


def _row(spark, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))


_OLS = "(SELECT l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem)"


def _gaussian(spark, d):
    return glm(*_columns(spark, d, "l_extendedprice / 1000", "l_quantity"), family="gaussian")


@query(f"SELECT round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope FROM {_OLS}")
def glm_gaussian_1(spark, d):
    b = _gaussian(spark, d).coefficients
    return _row(spark, intercept=round(float(b[0]), 6), slope=round(float(b[1]), 6))


@query(f"SELECT round(regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x), 2) AS deviance, round(regr_syy(y, x), 2) AS null_deviance FROM {_OLS}")
def glm_gaussian_deviance(spark, d):
    m = _gaussian(spark, d)
    return _row(spark, deviance=round(m.deviance, 2), null_deviance=round(m.null_deviance, 2))


@query(f"SELECT round(count(*) * (ln(2 * pi() * (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / count(*)) + 1) + 2 + 4, 2) AS aic FROM {_OLS}")
def glm_gaussian_aic(spark, d):
    return _row(spark, aic=round(_gaussian(spark, d).aic, 2))


@query(f"SELECT round(regr_slope(y, x), 6) AS slope, round(sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 8) AS std_error FROM {_OLS}")
def glm_summary(spark, d):
    s = _gaussian(spark, d).summary()
    return _row(spark, slope=round(float(s["estimate"].iloc[1]), 6), std_error=round(float(s["std_error"].iloc[1]), 8))


def _newton_sql(rows: str, mean: str, hessian: str, steps: int) -> str:
    out = f"WITH d AS MATERIALIZED ({rows}), b0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1)"
    for k in range(1, steps + 1):
        out += f", m{k} AS (SELECT x, y, {mean} AS h, b0, b1 FROM d, b{k - 1}), s{k} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(h - y) AS g0, sum((h - y) * x) AS g1, sum({hessian}) AS h00, sum({hessian} * x) AS h01, sum({hessian} * x * x) AS h11 FROM m{k})"
        out += f", b{k} AS MATERIALIZED (SELECT b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM s{k})"
    return out + f" SELECT round(b0, 6) AS intercept, round(b1, 6) AS slope FROM b{steps}"


_LOGIT = "SELECT (l_returnflag = 'R')::DOUBLE AS y, l_quantity / 10 AS x FROM lineitem"
_COUNT = "SELECT l_linenumber::DOUBLE AS y, l_quantity / 50 AS x FROM lineitem"


@query(_newton_sql(_LOGIT, "1 / (1 + exp(-(b0 + b1 * x)))", "h * (1 - h)", 3))
def glm_logit_newton_k(spark, d):
    b = glm(*_columns(spark, d, "l_returnflag = 'R'", "l_quantity / 10"), family="binomial", control=Control(epsilon=1e-300, maxit=3)).coefficients
    return _row(spark, intercept=round(float(b[0]), 6), slope=round(float(b[1]), 6))


@query(_newton_sql(_COUNT, "exp(b0 + b1 * x)", "h", 4))
def glm_poisson_newton_k(spark, d):
    b = glm(*_columns(spark, d, "l_linenumber", "l_quantity / 50"), family="poisson", control=Control(epsilon=1e-300, maxit=4)).coefficients
    return _row(spark, intercept=round(float(b[0]), 6), slope=round(float(b[1]), 6))


def _fit_sql(rows: str, mean: str, hessian: str, steps: int, then: str) -> str:
    """Newton's method as in _newton_sql, and a query over m: x, y and the fitted mean h."""
    fit = _newton_sql(rows, mean, hessian, steps).rsplit(" SELECT ", 1)[0]
    return f"{fit}, m AS (SELECT x, y, {mean} AS h, b0, b1 FROM d, b{steps}) {then}"


_LOGIT_MEAN, _COUNT_MEAN = "1 / (1 + exp(-(b0 + b1 * x)))", "exp(b0 + b1 * x)"


def _binomial(spark, d):
    return glm(*_columns(spark, d, "l_returnflag = 'R'", "l_quantity / 10"), family="binomial")


def _poisson(spark, d):
    return glm(*_columns(spark, d, "l_linenumber", "l_quantity / 50"), family="poisson")


def _figures(spark, m) -> DataFrame:
    s = m.summary()
    return _row(spark, deviance=round(m.deviance, 2), null_deviance=round(m.null_deviance, 2), aic=round(m.aic, 2), slope=round(float(s["estimate"].iloc[1]), 5), std_error=round(float(s["std_error"].iloc[1]), 6))


_ERROR = "round(sqrt(sum({h}) / (sum({h}) * sum({h} * x * x) - sum({h} * x) ** 2)), 6) AS std_error"


@query(_fit_sql(_LOGIT, _LOGIT_MEAN, "h * (1 - h)", 8, "SELECT round(-2 * sum(y * ln(h) + (1 - y) * ln(1 - h)), 2) AS deviance, round(-2 * (sum(y) * ln(avg(y)) + sum(1 - y) * ln(1 - avg(y))), 2) AS null_deviance, round(-2 * sum(y * ln(h) + (1 - y) * ln(1 - h)) + 4, 2) AS aic, round(any_value(b1), 5) AS slope, " + _ERROR.format(h="h * (1 - h)") + " FROM m"))
def glm_binomial_figures(spark, d):
    return _figures(spark, _binomial(spark, d))


@query(_fit_sql(_COUNT, _COUNT_MEAN, "h", 10, "SELECT round(2 * sum(y * ln(y / h) - (y - h)), 2) AS deviance, round(2 * (sum(y * ln(y)) - sum(y) * ln(avg(y))), 2) AS null_deviance, round(-2 * sum(y * ln(h) - h - lgamma(y + 1)) + 4, 2) AS aic, round(any_value(b1), 5) AS slope, " + _ERROR.format(h="h") + " FROM m"))
def glm_poisson_figures(spark, d):
    return _figures(spark, _poisson(spark, d))


_KINDS = {"response": "y - h", "pearson": "(y - h) / sqrt(h)", "working": "(y - h) / h", "deviance": "sign(y - h) * sqrt(greatest(0, 2 * (y * ln(y / h) - (y - h))))"}


@query(_fit_sql(_COUNT, _COUNT_MEAN, "h", 10, " UNION ALL ".join(f"SELECT '{k}' AS kind, round(sum({e}), 2) + 0.0 AS total, round(sum(({e}) ** 2), 2) AS squares, round(min({e}), 5) AS least, round(max({e}), 5) AS most FROM m" for k, e in _KINDS.items())))
def glm_fitted_residuals(spark, d):
    """Residuals of a fitted model, all kinds."""
    m = _poisson(spark, d)
    found = []
    for kind in _KINDS:
        v = F.col("value")
        found.append(m.residuals(kind).agg(F.lit(kind).alias("kind"), F.round(F.sum(v), 2).alias("total"), F.round(F.sum(v * v), 2).alias("squares"), F.round(F.min(v), 5).alias("least"), F.round(F.max(v), 5).alias("most")))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.withColumn("total", F.col("total") + F.lit(0.0))


_WEIGHTED = "SELECT l_linenumber::DOUBLE AS y, l_quantity / 50 AS x, l_linenumber % 3 + 1.0 AS w, l_discount AS o FROM lineitem"


def _weighted_sql(steps: int) -> str:
    out = f"WITH d AS MATERIALIZED ({_WEIGHTED}), b0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1)"
    for k in range(1, steps + 1):
        out += f", m{k} AS (SELECT x, y, w, exp(b0 + b1 * x + o) AS h, b0, b1 FROM d, b{k - 1}), s{k} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(w * (h - y)) AS g0, sum(w * (h - y) * x) AS g1, sum(w * h) AS h00, sum(w * h * x) AS h01, sum(w * h * x * x) AS h11 FROM m{k})"
        out += f", b{k} AS MATERIALIZED (SELECT b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM s{k})"
    return out + f" SELECT round(b0, 5) AS intercept, round(b1, 5) AS slope FROM b{steps}"


@query(_weighted_sql(12))
def glm_weights_and_offset(spark, d):
    rows = _table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias(RID), F.col("l_linenumber").cast("double").alias("y"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_linenumber") % 3 + 1).cast("double").alias("w"), F.col("l_discount").alias("o"))
    n = rows.count()
    column = lambda c: DArray(rows.select(RID, c), Grid((n,), (1,)), [c])
    b = glm(column("y"), column("x"), family="poisson", weights=column("w"), offset=column("o"), control=Control(epsilon=1e-12, maxit=30)).coefficients
    return _row(spark, intercept=round(float(b[0]), 5), slope=round(float(b[1]), 5))


@query("SELECT rid AS __rid, round(1 / (1 + exp(-(0.5 - 0.001 * b + 0.02 * a))), 8) AS value FROM " + _PARTS)
def glm_predict_response(spark, d):
    x = _part_array(spark, d)
    model = _fixed("binomial", [0.5, 0.02, -0.001])
    return _round(model.predict(x, "response"), 8)


@query("SELECT rid AS __rid, round(0.5 - 0.001 * b + 0.02 * a, 8) AS value FROM " + _PARTS)
def glm_predict_link(spark, d):
    return _round(_fixed("binomial", [0.5, 0.02, -0.001]).predict(_part_array(spark, d), "link"), 8)


def _fixed(family: str, beta: list[float], rows: DataFrame | None = None, names: list[str] = ()):
    from gridloom.algorithms.glm import Glm

    return Glm(family, np.array(beta), 0.0, 0.0, 0.0, 0, True, 0, 0, rows, list(names))


def _residuals(spark, d, kind: str) -> DataFrame:
    """Of a Poisson model with fixed coefficients: size by price."""
    x = _part_array(spark, d).df
    rows = x.select(RID, F.col("c1").alias("_y"), F.col("c2").alias("x"), F.lit(1.0).alias("_w"), F.lit(0.0).alias("_o"), F.exp(F.lit(3.0) + 0.0002 * F.col("c2")).alias("_mu"))
    return _round(_fixed("poisson", [3.0, 0.0002], rows, ["x"]).residuals(kind), 6)


_MU = f"(SELECT rid, a AS y, exp(3.0 + 0.0002 * b) AS mu FROM {_PARTS})"


@query(f"SELECT rid AS __rid, round(sign(y - mu) * sqrt(greatest(0, 2 * (CASE WHEN y = 0 THEN 0 ELSE y * ln(y / mu) END - (y - mu)))), 6) AS value FROM {_MU}")
def glm_residuals_deviance(spark, d):
    return _residuals(spark, d, "deviance")


@query(f"SELECT rid AS __rid, round((y - mu) / sqrt(mu), 6) AS value FROM {_MU}")
def glm_residuals_pearson(spark, d):
    return _residuals(spark, d, "pearson")


@query(f"SELECT rid AS __rid, round((y - mu) / mu, 6) AS value FROM {_MU}")
def glm_residuals_working(spark, d):
    return _residuals(spark, d, "working")


@query(f"SELECT rid AS __rid, round(y - mu, 6) AS value FROM {_MU}")
def glm_residuals_response(spark, d):
    return _residuals(spark, d, "response")


@query()
def forest_predict_rows(spark, d):
    x = from_dataframe(_table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), "p_partkey", None, ["p_brand", "p_size", "p_retailprice"])
    return random_forest(x, label="p_brand", ntree=10, max_depth=5, seed=1).predict(x)


@query()
def forest_regression_rows(spark, d):
    x = from_dataframe(_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", None, ["p_size", "p_retailprice"])
    return random_forest(x, formula="p_retailprice ~ p_size", ntree=10, max_depth=5, seed=1).predict(x)
