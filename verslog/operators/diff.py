"""Differences between two copies of a table, field by field, where a key may have several rows on either side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verslog.functions.hashing import row_hash
from verslog.operators.assignment import pair_rows


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    fields: list[str],
    names: tuple[str, str] = ("left", "right"),
    normal: dict[str, Callable[[Column], Column]] | None = None,
    extra_copies: bool = False,
) -> DataFrame:
    """Rows (keys..., ``difference``): ``missing_in_<name>`` for a key of one side only, or the name of a field that differs.

    Identical rows cancel by multiplicity. What is left under a key is paired so that the number of differing fields is
    least, and of those pairings so that the first of ``fields`` differs least often, then the second, whatever the order of rows. Each field in which a pair differs is one row (once for a key, however many pairs differ in it). Rows left
    without a partner while the other side has the key are surplus copies: with ``extra_copies`` they give
    ``extra_in_<name>``, else nothing. NULL equals NULL only, in keys and fields; ``normal`` maps fields to a normal form
    first. Other columns, whatever their names, aren't read. Two empty tables have no differences.

    Fields are compared by 64-bit hashes, made where the rows are read, so long values aren't shuffled and all aggregates stay
    hash aggregates. Identical rows are counted before the shuffle, so a key or row that fills a third of a side is a few rows afterwards.
    Only keys with several different leftovers on a side reach Python, where memory is in proportion to those leftovers.
    """
    normal = normal or {}
    K, V = [f"__k{i}" for i in range(len(keys))], [f"__f{i}" for i in range(len(fields))]

    def side(df: DataFrame, l: int) -> DataFrame:
        return df.select(
            *[F.col(k).alias(a) for k, a in zip(keys, K)], *[row_hash(normal.get(f, lambda c: c)(F.col(f))).alias(a) for f, a in zip(fields, V)], F.lit(l).cast("long").alias("__l"), F.lit(1 - l).cast("long").alias("__r")
        )

    variants = side(left, 1).unionByName(side(right, 0)).groupBy(*K, *V).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    more, less = F.col("__l") > F.col("__r"), F.col("__l") < F.col("__r")
    one = {f"__a{i}": F.max(F.when(more, F.col(v))) for i, v in enumerate(V)} | {f"__b{i}": F.max(F.when(less, F.col(v))) for i, v in enumerate(V)}
    by_key = (
        variants.groupBy(*K)
        .agg(
            F.sum("__l").alias("__l"), F.sum("__r").alias("__r"), F.count_if(more).alias("__dl"), F.count_if(less).alias("__dr"),
            F.sum(F.when(more, F.col("__l") - F.col("__r")).otherwise(0)).alias("__sl"), F.sum(F.when(less, F.col("__r") - F.col("__l")).otherwise(0)).alias("__sr"),
            *[c.alias(n) for n, c in one.items()],
        )
        .where("__dl > 0 or __dr > 0")
    )
    said = [
        F.when(F.col("__r") == 0, F.lit(f"missing_in_{names[1]}")).when(F.col("__l") == 0, F.lit(f"missing_in_{names[0]}")),
        *[F.when((F.col("__dl") == 1) & (F.col("__dr") == 1) & (F.col(f"__a{i}") != F.col(f"__b{i}")), F.lit(f)) for i, f in enumerate(fields)],
    ]
    if extra_copies:
        said += [F.when((F.col("__l") > 0) & (F.col("__r") > 0) & (F.col(a) > F.col(b)), F.lit(f"extra_in_{n}")) for n, a, b in ((names[0], "__sl", "__sr"), (names[1], "__sr", "__sl"))]
    plain = by_key.select(*K, F.explode(F.array_compact(F.array(*said))).alias("difference"))

    several = by_key.where("__dl > 0 and __dr > 0 and (__dl > 1 or __dr > 1)").select(*[F.col(k).alias(f"{k}s") for k in K])
    same = [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in K]
    left_over = variants.where("__l <> __r").join(several, same, "left_semi")
    n_keys = len(keys)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.column_stack([pd.factorize(pdf[v], use_na_sentinel=False)[0] for v in V])
        surplus = (pdf["__l"] - pdf["__r"]).to_numpy()
        a, b = np.repeat(codes, np.maximum(surplus, 0), axis=0), np.repeat(codes, np.maximum(-surplus, 0), axis=0)
        differ = {f for i, j in pair_rows(a, b) for f in np.flatnonzero(a[i] != b[j])}
        head = pdf.iloc[[0] * len(differ), :n_keys].reset_index(drop=True)
        return head.assign(difference=[fields[f] for f in sorted(differ)])

    paired = left_over.groupBy(*K).applyInPandas(assign, plain.schema)
    return plain.unionByName(paired).select(*[F.col(a).alias(k) for k, a in zip(keys, K)], "difference")
