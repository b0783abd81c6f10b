"""Compare rows without their order."""

import decimal
from collections import Counter


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


def rows(df):
    names = sorted(df.columns)
    return Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def oracle_rows(rel):
    names = list(rel.columns)
    at = [names.index(c) for c in sorted(names)]
    return Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
