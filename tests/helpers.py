"""Comparison of results, shared by the tests."""

DATA = "/root/testdata"


def rows_of(frame):
    """Rows as sorted strings, columns by name, whole floats and ints alike."""
    def shown(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, float):
            return repr(round(v, 9))
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted("|".join(shown(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def same(spark_frame, duck_relation):
    a, b = spark_frame.toPandas(), duck_relation.df()
    assert sorted(a.columns) == sorted(b.columns)
    for c in a.columns:
        if a[c].dtype.kind in "if" and b[c].dtype.kind in "if":
            a[c], b[c] = a[c].astype(float), b[c].astype(float)
    assert rows_of(a) == rows_of(b)
