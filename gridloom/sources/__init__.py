"""Ways to make distributed objects: constructors, local values, DataFrames and files."""

from gridloom.sources.constructors import as_darray, as_dframe, as_dlist, combine, darray, dframe, dlist, from_dataframe, sparse_from_dataframe
from gridloom.sources.files import read_dframe, write_dframe

__all__ = ["as_darray", "as_dframe", "as_dlist", "combine", "darray", "dframe", "dlist", "from_dataframe", "read_dframe", "sparse_from_dataframe", "write_dframe"]
