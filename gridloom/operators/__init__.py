"""Operators on distributed objects."""

from gridloom.operators.aggregates import bin_counts, col_means, col_medians, col_sums, largest, mean, row_means, row_sums, smallest, total, unique, which_max
from gridloom.operators.binding import cbind, rbind
from gridloom.operators.dmapply import dlapply, dmapply, map_cells, map_columns, map_items
from gridloom.operators.linalg import elementwise, matmul, transpose
from gridloom.operators.partitioning import repartition, split
from gridloom.operators.selection import element, head, index, reverse, tail

__all__ = [
    "bin_counts", "cbind", "col_means", "col_medians", "col_sums", "dlapply", "dmapply", "element", "elementwise", "head", "index", "largest", "map_cells", "map_columns", "map_items", "matmul", "mean", "rbind", "repartition", "reverse", "row_means", "row_sums", "smallest", "split", "tail", "total", "transpose", "unique", "which_max",
]
