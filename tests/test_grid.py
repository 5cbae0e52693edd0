import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid, cut, split_even


def test_even_split_gives_the_first_parts_one_more():
    assert split_even(5, 3) == [2, 2, 1]
    assert split_even(2, 4) == [1, 1, 0, 0]
    with pytest.raises(ValueError):
        split_even(3, 0)


def test_blocks_are_numbered_row_by_row():
    grid = Grid.by_size((20, 5), (3, 3))
    assert grid.nparts == (7, 2) and grid.total == 14
    assert grid.block(2) == (1, 3, 4, 5)
    assert grid.block(13) == (19, 20, 1, 3)
    assert grid.psize()[13] == (2, 2)
    for bad in (0, 15, -1):
        with pytest.raises(IndexError):
            grid.block(bad)
    assert cut(7, 3) == [3, 3, 1]


@pytest.mark.parametrize("heights", [(9, 1, 2, 4, 7, 5, 6, 3), (4, 4, 4, 2), (5,), (1, 5, 1)])
def test_row_block_column_agrees_with_the_binary_search(spark, heights):
    grid = Grid(heights, (1,))
    got = spark.range(1, sum(heights) + 1).select("id", grid.row_block_column(F.col("id")).alias("b")).collect()
    assert all(r["b"] == grid.row_block(r["id"]) for r in got)
