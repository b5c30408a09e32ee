"""Output presentation shared by the Spark queries and their SQL oracles.

A spec is ``"name:kind name:kind ..."``; both sides cast the same way so
results compare by value: ``s`` text, ``i`` BIGINT, ``d`` DOUBLE rounded to
6 places, ``t`` timestamp as ``yyyy-MM-ddTHH:mmZ`` text, ``date`` as
``yyyy-MM-dd`` text, ``b`` boolean, ``ad`` ARRAY<DOUBLE> rounded,
``aad`` ARRAY<ARRAY<DOUBLE>> rounded.  ``*:kind`` applies ``kind`` to every
column not named before it (for pivots whose width comes from the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.functions.calendar import TS_WRITE_FORMAT

DIGITS = 6


def parse_spec(spec: str) -> list[tuple[str, str]]:
    out = []
    for tok in spec.split():
        name, kind = tok.rsplit(":", 1)
        out.append((name, kind))
    return out


def _spark_expr(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "s":
        e = c.cast("string")
    elif kind == "i":
        e = c.cast("long")
    elif kind == "d":
        e = F.round(c.cast("double"), DIGITS)
    elif kind == "t":
        e = F.date_format(c, TS_WRITE_FORMAT)
    elif kind == "date":
        e = F.date_format(c, "yyyy-MM-dd")
    elif kind == "b":
        e = c.cast("boolean")
    elif kind == "ad":
        e = F.transform(c, lambda v: F.round(v.cast("double"), DIGITS))
    elif kind == "aad":
        e = F.transform(c, lambda r: F.transform(r, lambda v: F.round(v.cast("double"), DIGITS)))
    else:
        raise ValueError(kind)
    return e.alias(name)


def present(df: DataFrame, spec: str) -> DataFrame:
    items = parse_spec(spec)
    named = [n for n, _ in items if n != "*"]
    cols = []
    for n, k in items:
        if n == "*":
            cols += [_spark_expr(c, k) for c in df.columns if c not in named]
        else:
            cols.append(_spark_expr(n, k))
    return df.select(*cols)


def _sql_expr(name: str, kind: str) -> str:
    c = '"' + name.replace('"', '""') + '"'
    if kind == "s":
        e = f"CAST({c} AS VARCHAR)"
    elif kind == "i":
        e = f"CAST({c} AS BIGINT)"
    elif kind == "d":
        e = f"ROUND(CAST({c} AS DOUBLE), {DIGITS})"
    elif kind == "t":
        e = f"strftime({c}, '%Y-%m-%dT%H:%MZ')"
    elif kind == "date":
        e = f"strftime({c}, '%Y-%m-%d')"
    elif kind == "b":
        e = f"CAST({c} AS BOOLEAN)"
    elif kind == "ad":
        e = f"list_transform({c}, lambda v: ROUND(CAST(v AS DOUBLE), {DIGITS}))"
    elif kind == "aad":
        e = f"list_transform({c}, lambda r: list_transform(r, lambda v: ROUND(CAST(v AS DOUBLE), {DIGITS})))"
    else:
        raise ValueError(kind)
    return f"{e} AS {c}"


def wrap_sql(sql: str, spec: str) -> str:
    """Wrap an oracle query so its output is cast exactly like ``present``."""
    items = parse_spec(spec)
    named = [n for n, _ in items if n != "*"]
    parts = []
    for n, k in items:
        if n == "*":
            excl = ", ".join('"' + x + '"' for x in named)
            if k == "d":
                inner = f"ROUND(CAST(COLUMNS(* EXCLUDE ({excl})) AS DOUBLE), {DIGITS})"
            elif k == "i":
                inner = f"CAST(COLUMNS(* EXCLUDE ({excl})) AS BIGINT)"
            else:
                raise ValueError(k)
            parts.append(inner)
        else:
            parts.append(_sql_expr(n, k))
    return "SELECT " + ", ".join(parts) + f" FROM (\n{sql}\n) AS q"
