"""Comparison of small results."""


def as_set(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)
