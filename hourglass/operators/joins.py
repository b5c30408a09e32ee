"""Joins: attributes onto samples, timestamp semi-joins, key updates, parameter grids.

Broadcast policy: ``broadcast()`` is never written here.  Spark broadcasts a
side whose estimated size, or under AQE measured size, is below its threshold
and otherwise keeps a sort-merge join.  A join of many rows with one row per
key (statistics, models) is salted by ``per_key_join``, so a series with a
large share of the rows is spread over tasks also then.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.functions.calendar import attribute_columns


def with_attributes(x: DataFrame, attrs: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """LEFT join samples with a per-timestamp attribute table.

    With ``attrs=None`` the attributes are computed as a projection of
    ``ts`` (they are a pure function of it): no join, no shuffle.  With a
    given table it is a left equi-join on the timestamp, so unmatched rows
    get NULLs and duplicate timestamps in ``attrs`` multiply rows.
    """
    if attrs is None:
        return x.select("*", *attribute_columns(ts))
    return x.join(attrs, ts, "left")


SALTS = 8


def per_key_join(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``rows`` with a table of few rows per key, each key dealt to ``salts`` tasks.

    The small table is repeated once per salt; a row's salt is a hash of its
    plain columns, so a retried task deals its rows the same way.  The copies
    are dealt before the join, so Spark broadcasts them only if their measured
    size allows it.
    """
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct"))]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(salts)))
    copies = per_key.withColumn("_salt", F.explode(F.array(*[F.lit(s).cast("long") for s in range(salts)])))
    return salted.join(copies.repartition(*keys, "_salt"), [*keys, "_salt"], how).drop("_salt")


def semi_timestamps(attrs: DataFrame, x: DataFrame, ts: str = "ts") -> DataFrame:
    """Attribute rows whose timestamp occurs in ``x``."""
    return attrs.join(x.select(ts).distinct(), ts, "left_semi")


def fill_from(panel: DataFrame, preds: DataFrame, value: str = "value",
              prediction: str = "prediction", keys: Sequence[str] = ("series", "ts")) -> DataFrame:
    """Write predictions into the panel where ``keys`` match; other rows unchanged.

    Boolean marker columns of ``preds`` whose names start with ``_`` are
    carried (False where nothing was written).
    """
    extra = [c for c in preds.columns if c.startswith("_")]
    p = preds.select(*keys, F.col(prediction).alias("_pred"), *extra)
    out = (panel.join(p, list(keys), "left")
           .withColumn(value, F.when(F.col("_pred").isNotNull(), F.col("_pred")).otherwise(F.col(value)))
           .drop("_pred"))
    # Marker columns of ``preds`` (leading underscore) say which rows were written.
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in extra})


def unmatched(preds: DataFrame, panel: DataFrame, keys: Sequence[str] = ("series", "ts")) -> DataFrame:
    """Predictions whose key is not in the panel (the reference only warns about them)."""
    return preds.join(panel.select(*keys), list(keys), "left_anti")


def param_rows(params: Mapping[str, Sequence], skip: Callable[[dict], bool] | None = None) -> list[dict]:
    """The configs of ``param_grid`` as dicts with ``config_id`` first."""
    names, rows = list(params), []
    for combo in itertools.product(*[list(params[n]) for n in names]):
        d = dict(zip(names, combo))
        if skip is None or not skip(d):
            rows.append({"config_id": len(rows) + 1, **d})
    return rows


def grid_rows(grid: DataFrame | Sequence[Mapping]) -> list[dict]:
    """A grid as dicts; a DataFrame's rows are read by the driver (a parameter table of a few rows)."""
    return [r.asDict() for r in grid.collect()] if isinstance(grid, DataFrame) else [dict(r) for r in grid]


def param_grid(spark: SparkSession, params: Mapping[str, Sequence],
               skip: Callable[[dict], bool] | None = None) -> DataFrame:
    """Cartesian product of parameter lists, in nested-loop order, with a ``config_id`` from 1.

    The lists are user parameters (a few values each), so the product is
    made from them directly; ``skip`` drops combinations like the
    reference's ``continue`` rule.
    """
    names = list(params)
    rows = [{n: r[n] for n in names} for r in param_rows(params, skip)]
    kinds = []
    for n in names:
        vals = [r[n] for r in rows]
        if any(isinstance(v, str) for v in vals):
            kinds.append("string")
        elif any(isinstance(v, bool) for v in vals):
            kinds.append("boolean")
        elif any(isinstance(v, float) for v in vals):
            kinds.append("double")
        else:
            kinds.append("bigint")
    conv = {"double": float, "string": str, "boolean": bool, "bigint": int}
    data = [(i + 1, *[conv[k](r[n]) for k, n in zip(kinds, names)]) for i, r in enumerate(rows)]
    schema = "config_id bigint, " + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    return spark.createDataFrame(data, schema)


def grid_literal(grid_rows: Sequence[Mapping]) -> Column:
    """A grid as an ARRAY<STRUCT> literal column: exploding it pairs rows with configs, no join."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in grid_rows])


def with_grid(df: DataFrame, grid: DataFrame | Sequence[Mapping]) -> DataFrame:
    """Every row of ``df`` once per config of a parameter grid (each config is its own fit).

    The grid is a parameter table whose size is fixed by its value lists; it
    is inlined as a literal array and exploded, so no join is planned.  Callers attach it to per-key
    summaries (sufficient statistics), not to raw rows.
    """
    lit_rows = grid_rows(grid)
    cols = list(lit_rows[0]) if lit_rows else []
    return (df.withColumn("_cfg", F.explode(grid_literal(lit_rows)))
            .select(*[c for c in df.columns], *[F.col(f"_cfg.{c}").alias(c) for c in cols]))
