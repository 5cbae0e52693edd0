"""The parallel map over elements, columns, cells or partitions.

Two ways to say what is mapped:

* ``map_items``, ``map_columns`` and ``map_cells`` take functions of Columns, so
  Catalyst sees the whole computation and nothing leaves the JVM;
* ``dmapply`` takes any Python function.  Single items and cells stay columns: the
  function runs over Arrow batches of them, after a join by place where there are
  several iterables.  Columns and partitions become rows of (task, argument,
  payload), meet by task in one shuffle, and the function runs once per task on
  the executors.  A task holds its own arguments only, and of a column no more
  than a piece: the function sees a list whose values lie in a file.

Of ``dmapply``'s iterables a whole list gives its items, a frame its columns, an
array its cells in column-major order, and a list of partitions (or of lists of
them) its blocks: matrices, frames or lists.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable
from functools import reduce
from itertools import batched, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import session
from gridloom.grid import Grid, split_even
from gridloom.index import RID
from gridloom.objects import DArray, DFrame, DList, DObject, SparseArray, Table, WideArray, quoted
from gridloom.operators.spooled import ColumnValues
from gridloom.storage import materialise

_ROWS = "task long, arg int, pos int, seq long, payload binary"


def map_items(f: Callable[..., Column], *lists: DList) -> DList:
    """f of the items at each place, as an expression."""
    _same({len(x) for x in lists})
    named = [x.df.select("idx", F.col("value").alias(f"_{k}")) for k, x in enumerate(lists)]
    joined = reduce(lambda a, b: a.join(b, "idx"), named)
    return DList(joined.select("idx", f(*(F.col(f"_{k}") for k in range(len(lists)))).alias("value")), list(lists[0].grid.rows))


def map_columns(f: Callable[[Column], Column], frame: Table) -> DataFrame:
    """An aggregate of every column in one pass: j, name, value."""
    one = frame.df.agg(*(f(quoted(c)).alias(f"_{k}") for k, c in enumerate(frame.columns)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k + 1).cast("long").alias("j"), F.lit(c).alias("name"), F.col(f"_{k}").alias("value")) for k, c in enumerate(frame.columns)))))


def map_cells(f: Callable[[Column], Column], array: DArray) -> DList:
    """f of every cell, in column-major order."""
    n, p = array.dim
    cells = array.coo().select(((F.col("j") - 1) * n + F.col("i")).alias("idx"), f(F.col("v")).alias("value"))
    return DList(cells, split_even(n * p, array.total_parts))


def _same(sizes: set[int]) -> int:
    if len(sizes) != 1:
        raise ValueError("all iterables must have one length")
    n = sizes.pop()
    if n == 0:
        raise ValueError("iterables must not be empty")
    return n


#: Bytes of a payload, unless one row has more: an Arrow batch has 1,024 payloads.
_PIECE = 1 << 16
#: Rows of a frame that are together while its columns are packed, as a power of 2.
_RUN_BITS = 14


def _pieces(n: int, dump: Callable[[int, int], bytes]) -> list[tuple[int, bytes]]:
    """n rows as payloads: the first row and dump(first, end) of each."""
    whole = dump(0, n)
    step = max(1, n * _PIECE // len(whole))
    return [(0, whole)] if step >= n else [(a, dump(a, min(n, a + step))) for a in range(0, n, step)]


def _columns(x: DFrame, arg: int) -> DataFrame:
    """Payloads of a frame's columns, all in one pass.  Rows come in order and no payload crosses a run, so that those of a column follow each other by seq."""
    named = x.df.select(F.col(RID).alias("seq"), *(quoted(c).alias(f"_{j}") for j, c in enumerate(x.columns, 1)))
    tasks = range(1, len(x.columns) + 1)

    def run(batches):
        for batch in batches:
            out = []
            for _, part in batch.groupby(batch["seq"] // (1 << _RUN_BITS)):
                seq = part["seq"].tolist()
                for j in tasks:
                    values = part[f"_{j}"].tolist()
                    out += [(j, arg, 0, seq[a], piece) for a, piece in _pieces(len(seq), lambda a, b: ColumnValues.packed(values[a:b]))]  # noqa: B023
            yield pd.DataFrame(out, columns=["task", "arg", "pos", "seq", "payload"])

    return named.repartition(F.shiftright("seq", _RUN_BITS)).sortWithinPartitions("seq").mapInPandas(run, _ROWS)


def _pack(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Rows of a block (task, arg, pos, seq and columns) as payloads for each batch of a block."""

    def run(batches):
        for batch in batches:
            for (task, arg, pos), part in batch.groupby(["task", "arg", "pos"]):
                seq = part["seq"].to_numpy()
                values = part[columns].reset_index(drop=True)
                body = values["value"].tolist() if kind == "list" else np.array(values["row"].tolist(), float) if kind == "wide" else values.to_numpy(float) if kind == "matrix" else values
                out = _pieces(len(seq), lambda a, b: pickle.dumps((seq[a:b], body[a:b])))  # noqa: B023
                yield pd.DataFrame({"task": task, "arg": arg, "pos": pos, "seq": [int(seq[a]) for a, _ in out], "payload": [p for _, p in out]})

    return df.mapInPandas(run, _ROWS)


def _blocks(placed: list[tuple[int, int, DObject]], arg: int) -> list[DataFrame]:
    """Payloads of the partitions that tasks ask for: (task, position in its group, partition)."""
    by_owner: dict[int, tuple[DObject, list[tuple[int, int, int]]]] = {}
    for task, pos, view in placed:
        owner, k = view.origin or (view, 1)
        by_owner.setdefault(id(owner), (owner, []))[1].append((task, pos, k))
    out = []
    for owner, wanted in by_owner.values():
        spark = owner.df.sparkSession
        cols = len(owner.grid.cols)
        asked = spark.createDataFrame([(t, q, (k - 1) // cols, (k - 1) % cols) for t, q, k in wanted], "task long, pos int, _r int, _c int")
        lit = F.lit(arg).alias("arg")
        if isinstance(owner, DList):
            rows = owner.df.withColumn("_r", owner.grid.row_block_column(F.col("idx"))).join(asked, "_r")
            out.append(_pack(rows.select("task", lit, "pos", F.col("idx").alias("seq"), "value"), "list", ["value"]))
            continue
        if isinstance(owner, SparseArray):
            cells = owner.df
            row, column = owner.grid.row_block_column(F.col("i")), Grid(owner.grid.cols, (1,)).row_block_column(F.col("j"))
            heights = [sum(owner.grid.rows[:k]) for k in range(len(owner.grid.rows))]
            widths = [sum(owner.grid.cols[:k]) for k in range(cols)]
            local = cells.withColumn("_r", row).withColumn("_c", column).join(asked, ["_r", "_c"])
            shift = lambda c, offsets: F.col(c) - F.array(*map(F.lit, offsets))[F.col("_r" if c == "i" else "_c")]
            out.append(_pack(local.select("task", lit, "pos", F.col("i").alias("seq"), shift("i", heights).alias("i"), shift("j", widths).alias("j"), "v"), "cells", ["i", "j", "v"]))
            continue
        keyed = owner.df.withColumn("_r", owner.grid.row_block_column(F.col(RID)))
        for c in sorted({(k - 1) % cols for _, _, k in wanted}):
            _, _, c0, c1 = owner.grid.block(c + 1)
            here = keyed.join(asked.where(F.col("_c") == c), "_r")
            if isinstance(owner, WideArray):
                out.append(_pack(here.select("task", lit, "pos", F.col(RID).alias("seq"), F.slice("row", c0, c1 - c0 + 1).alias("row")), "wide", ["row"]))
            else:
                names = owner.columns[c0 - 1 : c1]
                kind = "frame" if isinstance(owner, DFrame) else "matrix"
                out.append(_pack(here.select("task", lit, "pos", F.col(RID).alias("seq"), *map(quoted, names)), kind, names))
    return out


def _plain(v):
    """A value as Python has it: missing ones are None."""
    return None if v is None or v is pd.NaT else v.item() if isinstance(v, np.generic) else v


def _payload(df: DataFrame) -> DataFrame:
    """Items (task, arg, seq, value or, if pickled, payload) as rows for tasks that other iterables share."""
    if "payload" in df.columns:
        return df.select("task", "arg", F.lit(0).alias("pos"), "seq", "payload")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"task": b["task"], "arg": b["arg"], "pos": 0, "seq": b["seq"], "payload": [pickle.dumps(_plain(v)) for v in b["value"]]})

    return df.mapInPandas(run, _ROWS)


def _argument(x, arg: int) -> tuple[int, str, dict, list[DataFrame]]:
    """Length, kind, what a task must know of its shape, and rows of one iterable."""
    spark = session.current().spark
    if isinstance(x, DObject) and x.df.sparkSession is not spark:
        raise ValueError("the object belongs to another backend")
    if isinstance(x, DList):
        rows = x.df.select(F.col("idx").alias("task"), F.lit(arg).alias("arg"), F.lit(0).cast("long").alias("seq"), F.col("value").alias("payload" if x.pickled else "value"))
        return len(x), "item", {}, [rows]
    if isinstance(x, DFrame):
        return len(x.columns), "column", {}, [_columns(x, arg)] if x.columns else []
    if isinstance(x, (DArray, SparseArray)):
        n, p = x.dim
        cells = x.coo().select(((F.col("j") - 1) * n + F.col("i")).alias("task"), F.lit(arg).alias("arg"), F.lit(0).cast("long").alias("seq"), F.col("v").alias("value"))
        return n * p, "cell" if isinstance(x, SparseArray) else "item", {}, [cells]
    items = [x[c].to_numpy() for c in x.columns] if isinstance(x, pd.DataFrame) else list(x.ravel(order="F")) if isinstance(x, np.ndarray) else list(x)
    if any(isinstance(v, DObject) for v in items):
        if not all(isinstance(v, DObject) for v in items):
            raise ValueError("partitions and other values are mixed")
        shapes = {t: (v.kind, v.dim, getattr(v, "columns", None)) for t, v in enumerate(items, 1)}
        return len(items), "block", shapes, _blocks([(t, 0, v) for t, v in enumerate(items, 1)], arg)
    if items and all(isinstance(v, (list, tuple)) and all(isinstance(p, DObject) for p in v) for v in items) and any(items):
        shapes = {t: [(p.kind, p.dim, getattr(p, "columns", None)) for p in v] for t, v in enumerate(items, 1)}
        return len(items), "group", shapes, _blocks([(t, q, p) for t, v in enumerate(items, 1) for q, p in enumerate(v)], arg)
    rows = [(t, arg, 0, pickle.dumps(v.item() if isinstance(v, np.generic) else v)) for t, v in enumerate(items, 1)]
    return len(items), "item", {}, [spark.createDataFrame(rows, "task long, arg int, seq long, payload binary")]


def _block(shape, chunks: list[tuple]):
    """A block of its chunks."""
    kind, (n, p), columns = shape
    chunks = sorted(chunks, key=lambda c: int(c[0][0]))
    if kind == "sparse_darray":
        out = np.zeros((n, p))
        for _, cells in chunks:
            out[cells["i"].to_numpy() - 1, cells["j"].to_numpy() - 1] = cells["v"].to_numpy()
        return out
    if not chunks:
        return [] if kind == "dlist" else np.zeros((n, p)) if kind == "darray" else pd.DataFrame(columns=columns)
    order = np.argsort(np.concatenate([s for s, _ in chunks]), kind="stable")
    if kind == "dlist":
        flat = [v for _, part in chunks for v in part]
        return [flat[i] for i in order]
    if kind == "darray":
        return np.concatenate([b for _, b in chunks])[order]
    return pd.concat([b for _, b in chunks], ignore_index=True).iloc[order].reset_index(drop=True)


_RESULT = "task long, pos long, n long, p long, meta string, payload binary"


def _matrix(value) -> pd.DataFrame:
    if isinstance(value, pd.DataFrame):
        return value.reset_index(drop=True)
    value = np.asarray(value, float)
    value = value.reshape(1, 1) if value.ndim == 0 else value.reshape(-1, 1) if value.ndim == 1 else value
    return pd.DataFrame(value)


def _kind_of(dtype) -> str:
    return "boolean" if dtype == bool else "long" if np.issubdtype(dtype, np.integer) else "double" if np.issubdtype(dtype, np.floating) else "string"


def dmapply(f: Callable, *args, more_args: dict | None = None, output_type: str = "dlist", nparts: int | tuple[int, int] | None = None, combine: str = "default") -> DObject:
    """Apply f to the first items of all iterables, to the second ones, and so on.

    output_type: dlist, darray, dframe or sparse_darray.  combine: default keeps
    results as items (or makes columns of them), c flattens lists by one level,
    rbind and cbind stitch the results of a partition.  more_args go whole to
    every call; distributed ones are collected first, up to ``MOST_SHARED`` cells.
    """
    if output_type not in ("dlist", "darray", "dframe", "sparse_darray"):
        raise ValueError(f"unknown output type {output_type!r}")
    if combine not in ("default", "c", "rbind", "cbind"):
        raise ValueError(f"unknown combine {combine!r}")
    if output_type == "dlist" and combine in ("rbind", "cbind"):
        raise ValueError("lists cannot be bound")
    if output_type == "sparse_darray" and combine not in ("rbind", "cbind"):
        raise ValueError("sparse arrays need rbind or cbind")
    if not args:
        raise ValueError("at least one iterable is needed")
    got = [_argument(x, a) for a, x in enumerate(args)]
    n = _same({g[0] for g in got})
    if nparts is None:
        first = next((x for x in args if isinstance(x, DObject)), None)
        nparts = first.total_parts if first is not None else n
    shape = (nparts, 1) if output_type == "dlist" and isinstance(nparts, int) else (1, nparts) if isinstance(nparts, int) else tuple(nparts)
    total = shape[0] * shape[1]
    if total > n:
        raise ValueError(f"{n} results cannot fill {total} partitions")
    spark = session.current().spark
    more = spark.sparkContext.broadcast({k: _whole(k, v) if isinstance(v, DObject) else v for k, v in (more_args or {}).items()})
    kinds, shapes = [g[1] for g in got], [g[2] for g in got]

    def argument(a: int, task: int, pieces):
        """One argument of a task, of its (task, arg, pos, payload) in order."""
        if kinds[a] in ("item", "cell"):
            return next((pickle.loads(x) for *_, x in pieces), 0.0)
        if kinds[a] == "column":
            return ColumnValues(x for *_, x in pieces)
        if kinds[a] == "block":
            return _block(shapes[a][task], [pickle.loads(x) for *_, x in pieces])
        found = {q: [pickle.loads(x) for *_, x in mine] for q, mine in groupby(pieces, itemgetter(2))}
        return [_block(s, found.get(q, [])) for q, s in enumerate(shapes[a][task])]

    def result(task: int, value):
        if output_type == "dlist":
            items = value if combine == "c" and isinstance(value, (list, tuple, np.ndarray, ColumnValues)) else [value]
            if len(items) == 0:
                yield task, -1, 0, 1, None, None
            for k, v in enumerate(items):
                yield task, k, len(items), 1, None, pickle.dumps(v.item() if isinstance(v, np.generic) else v)
            return
        if output_type in ("darray", "sparse_darray") and isinstance(value, (pd.DataFrame, str)):
            raise TypeError(f"a {type(value).__name__} is no block of an array")
        if output_type != "dframe" and isinstance(value, (int, float, np.number)):
            yield task, -1, 1, 1, '[["0", "double"]]', None
            yield task, 0, 1, 1, None, pickle.dumps((float(value),))
            return
        table = _matrix(value)
        yield task, -1, *table.shape, json.dumps([[str(c), _kind_of(t) if output_type == "dframe" else "double"] for c, t in zip(table.columns, table.dtypes, strict=True)]), None
        for k, r in enumerate(table.itertuples(index=False, name=None)):
            yield task, k, *table.shape, None, pickle.dumps(tuple(r))

    def run(batches):
        rows = ((t, a, q, b["payload"][i].as_py()) for b in batches for i, (t, a, q) in enumerate(zip(*(b[c].to_pylist() for c in ("task", "arg", "pos")), strict=True)))
        for task, mine in groupby(rows, itemgetter(0)):
            values = {a: argument(a, task, pieces) for a, pieces in groupby(mine, itemgetter(1)) if a >= 0}
            value = f(*(values[a] if a in values else argument(a, task, ()) for a in range(len(kinds))), **more.value)
            for some in batched(result(task, value), 1024):
                yield _record_batch(some)

    if all(kind in ("item", "cell") for kind in kinds):
        results = _by_item(spark, n, kinds, [g[3][0] for g in got], f, more, result)
    else:
        every = spark.range(1, n + 1).select(F.col("id").alias("task"), F.lit(-1).alias("arg"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("binary").alias("payload"))
        inputs = [_payload(df) if kind in ("item", "cell") else df for (_, kind, _, frames) in got for df in frames]
        rows = reduce(DataFrame.union, [every, *(df.select("task", "arg", "pos", "seq", "payload") for df in inputs)])
        # Spark sorts, and spills, so that Python has a batch of payloads at a time
        results = rows.repartition("task").sortWithinPartitions("task", "arg", "pos", "seq").mapInArrow(run, _RESULT)
    # the function runs once: what follows reads its results
    results = materialise(results, "dmapply")
    sizes = split_even(n, total)
    if output_type == "dlist":
        if combine != "c":
            return DList(results.select(F.col("task").alias("idx"), F.col("payload").alias("value")), sizes, True)
        lengths = dict(results.groupBy("task").agg(F.first("n")).collect())
        base = np.cumsum([0, *(lengths[t] for t in range(1, n + 1))])
        offsets = spark.createDataFrame([(t, int(base[t - 1])) for t in range(1, n + 1)], "task long, base long")
        ends = np.cumsum([0, *sizes])
        flat = results.where("pos >= 0").join(offsets, "task").select((F.col("base") + F.col("pos") + 1).alias("idx"), F.col("payload").alias("value"))
        return DList(flat, [int(base[b] - base[a]) for a, b in zip(ends[:-1], ends[1:], strict=True)], True)
    return _stitched(results, n, shape, sizes, output_type, "cbind" if combine in ("default", "c") else combine)


#: Cells or items of a distributed value that may go to every task as one of more_args.
MOST_SHARED = 50_000_000


def _whole(name: str, value: DObject):
    """A distributed value that every call gets: collected once, and broadcast."""
    if len(value) > MOST_SHARED:
        raise ValueError(f"{name} has {len(value)} cells: too many to give to every task; map over it instead")
    return value.collect()


def _by_item(spark, n: int, kinds: list[str], frames: list[DataFrame], f: Callable, more, result: Callable) -> DataFrame:
    """The function on rows of one item of each iterable; nothing is grouped."""
    named = [df.select("task", F.struct(F.col("payload" if "payload" in df.columns else "value").alias("v")).alias(f"_{k}")) for k, df in enumerate(frames)]
    pickled = ["payload" in df.columns for df in frames]
    if "cell" in kinds:  # absent cells have no row
        named = [spark.range(1, n + 1).select(F.col("id").alias("task")), *named]
    rows = reduce(lambda a, b: a.join(b, "task", "left" if "cell" in kinds else "inner"), named)
    value = lambda k, kind: F.when(F.col(f"_{k}").isNull(), F.lit(0.0)).otherwise(F.col(f"_{k}.v")) if kind == "cell" else F.col(f"_{k}.v")
    rows = rows.select("task", *(value(k, kind).alias(f"_{k}") for k, kind in enumerate(kinds)))

    def values(column: pa.Array, is_pickled: bool) -> list:
        if is_pickled:
            return [pickle.loads(v) for v in column.to_pylist()]
        return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(column.type) else column.to_pylist()

    def run(batches):
        for batch in batches:
            task, *columns = batch.columns
            items = zip(*(values(c, p) for c, p in zip(columns, pickled, strict=True)), strict=True)
            out = [r for t, row in zip(task.to_pylist(), items, strict=True) for r in result(t, f(*row, **more.value))]
            if out:
                yield _record_batch(out)

    return rows.mapInArrow(run, _RESULT)


_RESULT_ARROW = pa.schema([("task", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("p", pa.int64()), ("meta", pa.string()), ("payload", pa.binary())])


def _record_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RESULT_ARROW.types, strict=True)], schema=_RESULT_ARROW)


def _stitched(results: DataFrame, n: int, shape: tuple[int, int], sizes: list[int], output_type: str, combine: str) -> Table | SparseArray:
    """Blocks of results, a grid of them, as one object; a row meets its pieces by its number."""
    found = {r["task"]: r for r in results.where("pos = -1").select("task", "n", "p", "meta").collect()}
    heights, widths = [None] * shape[0], [None] * shape[1]
    places, metas, task = [], {}, 1
    for k, size in enumerate(sizes):
        r, c = divmod(k, shape[1])
        mine = [found[t] for t in range(task, task + size)]
        if len({x["p" if combine == "rbind" else "n"] for x in mine}) != 1:
            raise ValueError("the results of a partition do not fit together")
        height = sum(x["n"] for x in mine) if combine == "rbind" else mine[0]["n"]
        width = mine[0]["p"] if combine == "rbind" else sum(x["p"] for x in mine)
        if heights[r] not in (None, height) or widths[c] not in (None, width):
            raise ValueError("partitions of one row must have one height, and of one column one width")
        heights[r], widths[c] = height, width
        metas.setdefault(c, []).extend(json.loads(mine[0]["meta"]) if combine == "rbind" else [m for x in mine for m in json.loads(x["meta"])]) if r == 0 else None
        at = 0
        for x in mine:
            places.append((x["task"], r, c, at if combine == "rbind" else 0, 0 if combine == "rbind" else at))
            at += x["n"] if combine == "rbind" else x["p"]
        task += size
    grid = Grid(tuple(heights), tuple(widths))
    above, beside = np.cumsum([0, *heights]), np.cumsum([0, *widths])
    spark = results.sparkSession
    table = spark.createDataFrame([(t, int(above[r] + a), int(beside[c] + b)) for t, r, c, a, b in places], "task long, _row long, _col long")
    pieces = results.where("pos >= 0").join(table, "task").select((F.col("_row") + F.col("pos") + 1).alias(RID), F.col("_col"), "payload")
    if output_type == "sparse_darray":

        def cells(batches):
            for b in batches:
                out = [(i, c + k + 1, v) for i, c, row in zip(b[RID], b["_col"], b["payload"], strict=True) for k, v in enumerate(pickle.loads(row)) if v != 0]
                yield pd.DataFrame(out, columns=["i", "j", "v"])

        return SparseArray(pieces.mapInPandas(cells, "i long, j long, v double"), grid)
    meta = [m for c in range(shape[1]) for m in metas[c]]
    names = [f"c{j}" for j in range(1, len(meta) + 1)] if output_type == "darray" else _distinct([f"X{j}" if m[0].isdigit() else m[0] for j, m in enumerate(meta, 1)])
    whole = pieces.groupBy(RID).agg(F.sort_array(F.collect_list(F.struct("_col", "payload"))).alias("_p")).select(RID, F.transform("_p", lambda x: x["payload"]).alias("_p"))

    def typed(batches):
        for b in batches:
            out = pd.DataFrame([[v for piece in row for v in pickle.loads(piece)] for row in b["_p"]], columns=names)
            for name, m in zip(names, meta, strict=True):
                out[name] = out[name].astype({"double": float, "long": "Int64", "boolean": "boolean", "string": object}[m[1]])
            out.insert(0, RID, b[RID].to_numpy())
            yield out

    df = whole.mapInPandas(typed, ", ".join([f"{RID} long", *(f"`{a}` {m[1]}" for a, m in zip(names, meta, strict=True))]))
    return DFrame(df, grid, names) if output_type == "dframe" else DArray(df, grid, names)


def _distinct(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        k, given = 0, name
        while given in out:
            k += 1
            given = f"{name}.{k}"
        out.append(given)
    return out


def dlapply(x, f: Callable, *, nparts: int | None = None, **more) -> DList:
    """dmapply over one iterable, whose results are items of a list."""
    return dmapply(f, x, more_args=more, nparts=nparts)
