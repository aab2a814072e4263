"""JSON paths that get_json_object lacks (``..``, slices, filters) and containment.

Spark's JSON functions are used wherever they can say it; these Arrow-batched functions are
for the rest."""

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"\.\.([A-Za-z_]\w*|\*)|\.([A-Za-z_]\w*|\*)|\[(\*|-?\d+|-?\d*:-?\d*|'[^']*'|\?\([^)]*\))\]")
_FILTER = re.compile(r"\?\(@\.(\w+)\s*(==|!=|<=|>=|<|>)\s*(.+)\)")


def _walk(v):
    yield v
    for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
        yield from _walk(x)


def _child(v, name):
    if isinstance(v, dict):
        return list(v.values()) if name == "*" else [v[name]] if name in v else []
    return list(v) if isinstance(v, list) and name == "*" else []


def _compare(a, op, b) -> bool:
    try:
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op] if op in ("==", "!=") or type(a) is type(b) or {type(a), type(b)} <= {int, float} else False
    except TypeError:
        return a == b if op == "==" else a != b if op == "!=" else False


def find_all(doc, path: str) -> list:
    """All values of a parsed document at a path."""
    at, pos = [doc], 1
    while pos < len(path):
        m = _STEP.match(path, pos)
        if not m:
            raise ValueError(f"bad JSON path: {path}")
        deep, name, index = m.groups()
        if deep:
            at = [y for v in at for x in _walk(v) for y in _child(x, deep)]
        elif name:
            at = [y for v in at for y in _child(v, name)]
        elif index == "*":
            at = [y for v in at for y in _child(v, "*")]
        elif index.startswith("'"):
            at = [y for v in at for y in _child(v, index[1:-1])]
        elif index.startswith("?"):
            key, op, raw = _FILTER.fullmatch(index).groups()
            want = json.loads(raw.replace("'", '"'))
            at = [y for v in at for y in _child(v, "*") if isinstance(y, dict) and key in y and _compare(y[key], op, want)]
        elif ":" in index:
            lo, hi = (int(x) if x else None for x in index.split(":"))
            at = [y for v in at if isinstance(v, list) for y in v[lo:hi]]
        else:
            at = [v[int(index)] for v in at if isinstance(v, list) and -len(v) <= int(index) < len(v)]
        pos = m.end()
    return at


def contains(a, b) -> bool:
    """Every key and element of b is in a."""
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(contains(x, y) for x in a) for y in b)
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def _load(x):
    try:
        return True, json.loads(x)
    except (TypeError, ValueError):
        return False, None


def json_path_all(doc: Column, path: Column) -> Column:
    """JSON array of all matches; null for no JSON."""

    @F.pandas_udf("string")
    def run(d: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(d, p):
            ok, v = _load(x)
            out.append(json.dumps(find_all(v, y), separators=(",", ":"), ensure_ascii=False) if ok and y is not None else None)
        return pd.Series(out, dtype=object)

    return run(doc, path)


def json_contains(a: Column, b: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for i, j in zip(x, y):
            (ok1, u), (ok2, v) = _load(i), _load(j)
            out.append(contains(u, v) if ok1 and ok2 else None)
        return pd.Series(out, dtype=object)

    return run(a, b)


def json_remove(doc: Column, keys: list[str]) -> Column:
    """The document without the value at a path of object keys."""

    @F.pandas_udf("string")
    def run(d: pd.Series) -> pd.Series:
        out = []
        for x in d:
            ok, v = _load(x)
            at = v
            for k in keys[:-1]:
                at = at.get(k) if isinstance(at, dict) else None
            if isinstance(at, dict):
                at.pop(keys[-1], None)
            out.append(json.dumps(v, separators=(",", ":"), ensure_ascii=False) if ok else None)
        return pd.Series(out, dtype=object)

    return run(doc)
