"""Functions that Spark's expressions lack, over Arrow batches. They run in Python workers: keep them out of hot paths."""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _values(returns: str, fn: Callable, *args: Column) -> Column:
    """fn over rows without a NULL argument; NULL for the others."""

    def rows(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v is pd.NA for v in row) else fn(*row) for row in zip(*columns, strict=True)], dtype=object)

    # the number of arguments is read from the signature
    def one(a: pd.Series) -> pd.Series:
        return rows(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return rows(a, b)

    return F.pandas_udf(one if len(args) == 1 else two, returns)(*args)


def _numbers(returns: str, fn: Callable, *args: Column) -> Column:
    """fn over rows whose doubles are there; NULL travels as text's absence, so that NaN stays a value."""
    whole = F.array(*[a.cast("double") for a in args])
    there = F.when(~F.exists(whole, lambda v: v.isNull()), whole)

    def batch(a: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(*v) for v in a], dtype=object)

    return F.pandas_udf(batch, returns)(there)


def gamma(x: Column) -> Column:
    """Infinite where it leaves the doubles; an error at 0, NaN at negative integers."""

    def one(v: float) -> float:
        if v == 0:
            raise ValueError("cannot take gamma of zero")
        try:
            return math.gamma(v)
        except OverflowError:
            return math.inf
        except ValueError:
            return math.nan

    return _numbers("double", one, x)


def lgamma(x: Column) -> Column:
    """Of the absolute value of gamma; an error at 0, infinite at negative integers."""

    def one(v: float) -> float:
        if v == 0:
            raise ValueError("cannot take log gamma of zero")
        try:
            return math.lgamma(v)
        except (OverflowError, ValueError):
            return math.inf

    return _numbers("double", one, x)


def next_after(x: Column, towards: Column) -> Column:
    return _numbers("double", lambda a, b: float(np.nextafter(a, b)), x, towards)


def nfc_normalize(s: Column) -> Column:
    return _values("string", lambda v: unicodedata.normalize("NFC", v), s)


def jaro_text(a: str, b: str) -> float:
    """Matches lie at most half the longer text apart; matched characters in another order count half."""
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == ch), None)
        if j is not None:
            taken[j] = True
            left.append(ch)
    if not left:
        return 0.0
    right = [ch for ch, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro(a: Column, b: Column) -> Column:
    return _values("double", jaro_text, a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro similarities over 0.7 gain a tenth of what is missing for each of up to four equal leading characters."""

    def one(x: str, y: str) -> float:
        s = jaro_text(x, y)
        head = 0
        for p, q in zip(x[:4], y[:4], strict=False):
            if p != q:
                break
            head += 1
        return s + head * 0.1 * (1 - s) if s > 0.7 else s

    return _values("double", one, a, b)


def damerau_levenshtein(a: Column, b: Column) -> Column:
    """Inserts, deletes, changes and swaps of neighbours, between which other edits may lie."""

    def one(x: str, y: str) -> int:
        far = len(x) + len(y)
        d = [[far] * (len(y) + 2) for _ in range(len(x) + 2)]
        for i in range(len(x) + 1):
            d[i + 1][1] = i
        for j in range(len(y) + 1):
            d[1][j + 1] = j
        last: dict[str, int] = {}
        for i, p in enumerate(x, 1):
            same = 0
            for j, q in enumerate(y, 1):
                k, m = last.get(q, 0), same
                if p == q:
                    same = j
                d[i + 1][j + 1] = min(d[i][j] + (p != q), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + i - k - 1 + 1 + j - m - 1)
            last[p] = i
        return d[-1][-1]

    return _values("long", one, a, b)


def _dump(v: object) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def json_contains(s: Column, part: Column) -> Column:
    """Whether the part is the value, one of its members' values, or a subset of it, at any depth."""

    def fits(v: object, p: object) -> bool:
        if isinstance(v, dict) and isinstance(p, dict) and all(k in v and fits(v[k], w) for k, w in p.items()):
            return True
        if isinstance(v, list) and isinstance(p, list) and all(any(fits(x, w) for x in v) for w in p):
            return True
        if type(v) is type(p) and v == p:
            return True
        inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
        return any(fits(x, p) for x in inner)

    return _values("boolean", lambda a, b: fits(json.loads(a), json.loads(b)), s, part)


def json_merge_patch(s: Column, patch: Column) -> Column:
    """Members of the patch replace those of the same name, null removes them."""

    def merged(v: object, p: object) -> object:
        if not isinstance(p, dict):
            return p
        out = dict(v) if isinstance(v, dict) else {}
        for k, w in p.items():
            if w is None:
                out.pop(k, None)
            else:
                out[k] = merged(out.get(k), w)
        return out

    return _values("string", lambda a, b: _dump(merged(json.loads(a), json.loads(b))), s, patch)


def _kind(v: object) -> str:
    if isinstance(v, bool):
        return "BOOLEAN"
    if isinstance(v, int):
        return "UBIGINT" if v >= 0 else "BIGINT"
    return {type(None): "NULL", float: "DOUBLE", str: "VARCHAR", list: "ARRAY", dict: "OBJECT"}[type(v)]


def json_type(s: Column) -> Column:
    return _values("string", lambda v: _kind(json.loads(v)), s)


def json_structure(s: Column) -> Column:
    """Types in place of values; a list has the types of its elements united."""

    def unite(a: object, b: object) -> object:
        if a == b or b == "NULL":
            return a
        if a == "NULL":
            return b
        if isinstance(a, dict) and isinstance(b, dict):
            return {k: unite(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in [*a, *[k for k in b if k not in a]]}
        if isinstance(a, list) and isinstance(b, list):
            return [unite(a[0], b[0])]
        numbers = {"UBIGINT", "BIGINT", "DOUBLE"}
        if isinstance(a, str) and isinstance(b, str) and {a, b} <= numbers:
            return "DOUBLE" if "DOUBLE" in (a, b) else "BIGINT"
        return "JSON"

    def of(v: object) -> object:
        if isinstance(v, dict):
            return {k: of(w) for k, w in v.items()}
        if isinstance(v, list):
            out: object = "NULL"
            for w in v:
                out = unite(out, of(w))
            return [out]
        return _kind(v)

    return _values("string", lambda v: _dump(of(json.loads(v))), s)


def json_pretty(s: Column) -> Column:
    return _values("string", lambda v: json.dumps(json.loads(v), ensure_ascii=False, indent=4), s)


def json_tree(s: Column) -> Column:
    """One element for each value at any depth, the whole first: key, value, type, atom, path of the parent and full key."""

    def rows(v: object, key: str | None, full: str, path: str) -> list[tuple]:
        atom = None if isinstance(v, (dict, list)) or v is None else _dump(v)
        out = [(key, _dump(v), _kind(v), atom, full, path)]
        if isinstance(v, dict):
            for k, w in v.items():
                out += rows(w, k, f"{full}.{k}" if k.isidentifier() else f'{full}."{k}"', full)
        elif isinstance(v, list):
            for i, w in enumerate(v):
                out += rows(w, str(i), f"{full}[{i}]", full)
        return out

    names = ("key", "value", "type", "atom", "fullkey", "path")
    return _values("array<struct<key:string,value:string,type:string,atom:string,fullkey:string,path:string>>", lambda v: [dict(zip(names, r, strict=True)) for r in rows(json.loads(v), None, "$", "$")], s)
