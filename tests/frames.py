"""Helpers that several test modules share."""


def rows(df, *cols):
    """Collect as sorted tuples (optionally of selected columns)."""
    if cols:
        df = df.select(*cols)
    return sorted(tuple(r) for r in df.collect())
