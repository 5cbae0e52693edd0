import pytest

#: Names that the operators use themselves.
INNER = "id _norm fp n key size label rank _row _drop _key _copies _rows _n _hash _id _keep component bucket node content sketch counted cluster_id kept _probable _s _bucket _bitmap keep_id group_size _digest _check _length _salt _texts copies taken times levels target source_size _slice _base _order piece length spans score predicted".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a table of documents from (id, text) or (id, text, source), with columns that clash with inner names."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
        df = spark.createDataFrame(rows, DOCS)
        return df.selectExpr("*", *(f"'x' AS {extra}" for extra in INNER))

    return make
