"""Helpers of several test modules. They have a module of their own because every folder's conftest has the same module name."""


def rows(df, *cols):
    """Sorted list of row tuples."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))
