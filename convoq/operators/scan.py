"""What comes before a row, over meetings of any length: a window, or a scan in two levels.

A window over a meeting is one task for the meeting: the cheapest form while no meeting has more than MANY rows, which is
counted first. Beyond that, rows are dealt by meeting and bin (a stretch of the first order column), each bin is
summarised in one row, and the summaries, few for a meeting, are scanned first. What a bin inherits then comes to it as a
row before its own, so that one window over meeting and bin sees all that it needs: the largest task holds a bin, not a
meeting, for one more shuffle of the rows. Both forms give the same results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bin in units of the first order column: ten minutes of milliseconds; rows where that column counts rows.
WIDTH = 600_000
ROWS = 20_000
#: Rows of a meeting that one task may hold.
MANY = 1_000_000


def crowded(df: DataFrame, partition: str | Sequence[str]) -> bool:
    """Whether a meeting has more than MANY rows (counted)."""
    keys = [partition] if isinstance(partition, str) else list(partition)
    return (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > MANY


def scan(
    df: DataFrame, partition: str | Sequence[str], order: Sequence[str], previous: Mapping[str, Column] | None = None, total: Mapping[str, Column] | None = None,
    most: Mapping[str, Column] | None = None, latest: Mapping[str, Column] | None = None, width: int = WIDTH, binned: bool | None = None,
) -> DataFrame:
    """df with new columns by name, of the rows before in the order of `order` (its first column is a number).

    previous: the value in the row before; total: the sum up to and with the row; most: the largest value of all rows
    before; latest: the last value that is not null, up to and with the row. Null where there is none (total: nulls count
    as 0). Rows with a null in the first order column come first, in a bin of their own. binned: take the two levels or
    not, whatever the meetings' rows.
    """
    keys = [partition] if isinstance(partition, str) else list(partition)
    previous, total, most, latest = (dict(x or {}) for x in (previous, total, most, latest))
    if not (crowded(df, keys) if binned is None else binned):
        w = Window.partitionBy(*keys).orderBy(*order)
        upto, above = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({
            **{n: F.lag(c).over(w) for n, c in previous.items()}, **{n: F.sum(F.coalesce(c, F.lit(0))).over(upto) for n, c in total.items()},
            **{n: F.max(c).over(above) for n, c in most.items()}, **{n: F.last(c, ignorenulls=True).over(upto) for n, c in latest.items()},
        })
    values = {f"__{kind}_{n}": c for kind, x in (("p", previous), ("t", total), ("m", most), ("l", latest)) for n, c in x.items()}
    bin_ = F.coalesce(F.floor(F.col(order[0]) / width).cast("long"), F.lit(-(1 << 62)))
    d = df.withColumns({"__bin": bin_, **values}).withColumn("__head", F.lit(1))
    if total:
        d = d.withColumns({f"__t_{n}": F.coalesce(F.col(f"__t_{n}"), F.lit(0)) for n in total})
    place = F.struct(*order)
    ends = d.groupBy(*keys, "__bin").agg(
        *[F.max_by(F.struct(f"__p_{n}"), place)[f"__p_{n}"].alias(f"__p_{n}") for n in previous],
        *[F.sum(f"__t_{n}").alias(f"__t_{n}") for n in total], *[F.max(f"__m_{n}").alias(f"__m_{n}") for n in most],
        *[F.max(F.when(F.col(f"__l_{n}").isNotNull(), F.struct(place.alias("o"), F.col(f"__l_{n}").alias("v"))))["v"].alias(f"__l_{n}") for n in latest],
    )
    bins = Window.partitionBy(*keys).orderBy("__bin")
    before = bins.rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(
        *keys, "__bin", F.lit(0).alias("__head"), *[F.lag(f"__p_{n}").over(bins).alias(f"__p_{n}") for n in previous], *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__t_{n}") for n in total],
        *[F.max(f"__m_{n}").over(before).alias(f"__m_{n}") for n in most], *[F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__l_{n}") for n in latest],
    )
    w = Window.partitionBy(*keys, "__bin").orderBy("__head", *order)
    upto, above = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    new = {
        **{n: F.lag(f"__p_{n}").over(w) for n in previous}, **{n: F.sum(f"__t_{n}").over(upto) for n in total},
        **{n: F.max(f"__m_{n}").over(above) for n in most}, **{n: F.last(f"__l_{n}", ignorenulls=True).over(upto) for n in latest},
    }
    return d.unionByName(heads, allowMissingColumns=True).withColumns(new).where("__head = 1").drop("__bin", "__head", *values)


def numbered(df: DataFrame, new: Column, partition: str | Sequence[str], order: Sequence[str], name: str, width: int = WIDTH, binned: bool | None = None) -> DataFrame:
    """df with a 0-based number that grows by one at each row where new holds."""
    return scan(df, partition, order, total={name: F.when(new, 1).otherwise(0)}, width=width, binned=binned).withColumn(name, (F.col(name) - 1).cast("long"))
