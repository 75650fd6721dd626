"""Rows of a result as sorted tuples."""


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
