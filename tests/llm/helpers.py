"""Plain-Python counterparts that the operators are held against."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def groups_of(n, linked):
    """Least member of each connected group of 0..n-1."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
