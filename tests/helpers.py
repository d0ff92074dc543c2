"""Comparison of a Spark result with the rows of a SQL statement, as bags."""

from collections import Counter


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return repr(v)


def bag(rows, columns):
    return Counter(tuple(shown(r[c]) for c in columns) for r in rows)


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    names = want.columns
    expected = bag([dict(zip(names, r)) for r in want.fetchall()], columns)
    assert bag([r.asDict() for r in df.collect()], columns) == expected
