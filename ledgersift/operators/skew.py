"""Joins that stay balanced when one key, or NULL, holds a large share of the rows.

Three devices are used throughout the package:

* summaries are grouped by the join key first, so a hot key is combined on the map side and
  reaches the join as one row (see ``references`` and ``facts``);
* ``resolve`` attaches parent columns to child rows: the few hot keys are answered from a
  broadcast table of bounded size, everything else by a normal join, and rows that need no
  lookup (NULL or already answered) are spread evenly over the reducers;
* ``expand`` joins a parent to its children and keeps every pair: children of a hot parent are
  split over salts and only that parent row is repeated, once per salt.

No device changes a result. Rows are never dropped, capped or sampled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class SkewPolicy:
    """When a key counts as hot.

    ``rows_per_task``: more rows than this under one key are worth splitting, and a split holds
    about this many. All such keys are split; there are fewer of them than rows divided by
    ``rows_per_task``, which bounds the broadcast table of hot keys (a hundred thousand for 10^11
    rows). ``max_hot_keys`` may bound it further; then the largest are split. A parent of at most
    ``broadcast_rows`` counted rows may be broadcast.
    """

    rows_per_task: int = 1_000_000
    max_hot_keys: int | None = None
    broadcast_rows: int = 100_000


COUNT_THEM = "count"
NO_HOT_KEYS = "none"

# Hot keys of a join: a frame of them, counted on the spot, or known not to exist.
HotKeys = DataFrame | str


def key_set(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Distinct non-NULL values of a key; duplicates are combined before the shuffle."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias(name or key)).distinct()


def hot_keys(df: DataFrame, key: str, policy: SkewPolicy) -> DataFrame:
    """(hot_key, n_salts): the keys with too many rows for one task."""
    counts = (df.where(F.col(key).isNotNull())
              .groupBy(F.col(key).alias("hot_key"))
              .agg(F.count(F.lit(1)).alias("key_rows")))
    return largest(counts, policy)


def largest(counts: DataFrame, policy: SkewPolicy, *by: str) -> DataFrame:
    """The hot part of an existing (hot_key, key_rows) count, of each ``by`` on its own."""
    hot = counts.where(F.col("key_rows") > policy.rows_per_task)
    if policy.max_hot_keys is not None:
        place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("key_rows"), F.asc("hot_key")))
        hot = hot.withColumn("_place", place).where(F.col("_place") <= policy.max_hot_keys)
    return hot.select(*by, "hot_key", F.ceil(F.col("key_rows") / policy.rows_per_task).cast("int").alias("n_salts"))


def _hot(child: DataFrame, fk: str, policy: SkewPolicy | None, hot: HotKeys) -> DataFrame | None:
    """The frame of hot keys, counted now if need be; None when there can be none."""
    if isinstance(hot, str):
        return hot_keys(child, fk, policy or SkewPolicy()) if hot == COUNT_THEM else None
    return hot


def scatter(spread_by: Sequence[str]) -> Column:
    """A per-row hash that a retried task computes again to the same value.

    The partition id separates identical rows; it depends on the plan, not on row order.
    """
    return F.xxhash64(*[F.col(c) for c in spread_by], F.spark_partition_id())


def _always_zero(key: Column) -> Column:
    """0, but not a constant to the optimizer, so that it stays a join key."""
    return F.pmod(F.xxhash64(key), F.lit(1).cast("long"))


def one_row_per_key(df: DataFrame, key: Column, values: Sequence[str], unique: bool = False) -> DataFrame:
    """(_pk, _zero, _hit, values...): one row per non-NULL key, since Parquet enforces no key.

    ``_zero`` is always 0. It is a grouping column so that the shuffle made here already is the
    one the join in ``resolve`` needs. ``unique`` says the frame is already grouped by the key.
    """
    keyed = (df.select(key.alias("_pk"), *[F.col(v).alias(f"_v_{v}") for v in values])
             .where(F.col("_pk").isNotNull())
             .withColumn("_zero", _always_zero(F.col("_pk"))))
    if unique:
        return keyed.withColumn("_hit", F.lit(True))
    groups = keyed.groupBy("_pk", "_zero")
    if not values:
        return groups.agg(F.lit(True).alias("_hit"))
    if len(values) == 1:
        return groups.agg(F.lit(True).alias("_hit"), F.min(f"_v_{values[0]}").alias(f"_v_{values[0]}"))
    picked = groups.agg(F.lit(True).alias("_hit"), F.min(F.struct(*[f"_v_{v}" for v in values])).alias("_row"))
    return picked.select("_pk", "_zero", "_hit", *[F.col(f"_row._v_{v}").alias(f"_v_{v}") for v in values])


def resolve(child: DataFrame, parent: DataFrame, fk: str, pk: str, *, found: str,
            values: dict[str, str] | None = None, spread_by: Sequence[str] = (),
            policy: SkewPolicy | None = None, hot: HotKeys = COUNT_THEM,
            unique_parent: bool = False, small_parent: bool = False) -> DataFrame:
    """Child rows plus ``found`` (does the parent exist?) and parent columns; one row per child row.

    ``values`` maps parent columns to result names. A NULL foreign key is never found.
    ``spread_by`` names child columns that tell rows apart (the child's own key).
    ``small_parent`` says the caller has checked that the parent may be broadcast.
    """
    values = values or {}
    columns = child.columns
    spread_by = list(spread_by) or [fk]
    hot = _hot(child, fk, policy, NO_HOT_KEYS if small_parent else hot)
    parents = one_row_per_key(parent, F.col(pk), list(values), unique_parent)
    if small_parent:
        joined = child.join(F.broadcast(parents), F.col(fk) == F.col("_pk"), "left")
        return joined.select(*columns, F.coalesce("_hit", F.lit(False)).alias(found),
                             *[F.col(f"_v_{v}").alias(name) for v, name in values.items()])

    staged, cold, near = child, F.col(fk), None
    if hot is not None:
        # A row for each hot key, of which there are few (see SkewPolicy).
        hot = F.broadcast(hot.select("hot_key"))
        near = F.broadcast(_hot_parents(parent, pk, list(values), hot, unique_parent))
        staged = (child.join(hot, F.col(fk) == F.col("hot_key"), "left")
                  .join(near, F.col(fk) == F.col("_near_pk"), "left"))
        cold = F.when(F.col("hot_key").isNull(), F.col(fk))
    answers = [] if near is None else ["hot_key", "_near_hit", *[f"_near_{v}" for v in values]]
    staged = staged.select(
        *columns, *answers, cold.alias("_cold"),
        F.when(cold.isNull(), scatter(spread_by)).otherwise(F.lit(0).cast("long")).alias("_spread"))
    joined = staged.join(
        parents, (F.col("_cold") == F.col("_pk")) & (F.col("_spread") == F.col("_zero")), "left")

    def answer(cold_column: str, near_column: str) -> Column:
        if near is None:
            return F.col(cold_column)
        return F.when(F.col("hot_key").isNotNull(), F.col(near_column)).otherwise(F.col(cold_column))

    return joined.select(*columns, F.coalesce(answer("_hit", "_near_hit"), F.lit(False)).alias(found),
                         *[answer(f"_v_{v}", f"_near_{v}").alias(name) for v, name in values.items()])


def _hot_parents(parent: DataFrame, pk: str, values: list[str], hot: DataFrame, unique: bool) -> DataFrame:
    """(_near_pk, _near_hit, _near_values...): the parents of hot keys, one row each."""
    rows = one_row_per_key(parent.join(hot, F.col(pk) == F.col("hot_key"), "left_semi"), F.col(pk), values, unique)
    return rows.select(F.col("_pk").alias("_near_pk"), F.col("_hit").alias("_near_hit"),
                       *[F.col(f"_v_{v}").alias(f"_near_{v}") for v in values])


def match(child: DataFrame, parent: DataFrame, fk: str, pk: str, *, values: dict[str, str],
          policy: SkewPolicy | None = None, hot: HotKeys = COUNT_THEM,
          unique_parent: bool = False, small_parent: bool = False) -> DataFrame:
    """Child rows that have a parent, plus parent columns; one row per child row.

    Rows of hot keys meet their parents in a broadcast join and are never shuffled; the others
    take an inner join, which Spark may narrow with a runtime filter. For a child that is cheap
    to read twice; without hot keys the first branch is empty and is not run.
    """
    columns = child.columns
    hot = _hot(child, fk, policy, NO_HOT_KEYS if small_parent else hot)
    parents = one_row_per_key(parent, F.col(pk), list(values), unique_parent)
    parents = F.broadcast(parents) if small_parent else parents
    cold = child
    if hot is not None:
        hot = F.broadcast(hot.select("hot_key"))
        cold = child.join(hot, F.col(fk) == F.col("hot_key"), "left_anti")
    others = (cold.join(parents, F.col(fk) == F.col("_pk"), "inner")
              .select(*columns, *[F.col(f"_v_{v}").alias(name) for v, name in values.items()]))
    if hot is None:
        return others
    near = F.broadcast(_hot_parents(parent, pk, list(values), hot, unique_parent))
    answered = (child.join(near, F.col(fk) == F.col("_near_pk"), "inner")
                .select(*columns, *[F.col(f"_near_{v}").alias(name) for v, name in values.items()]))
    return others.unionByName(answered)


def expand(parent: DataFrame, child: DataFrame, pk: str, fk: str, *, how: str,
           spread_by: Sequence[str], policy: SkewPolicy | None = None, hot: HotKeys = COUNT_THEM,
           parent_spread_by: Sequence[str] = ()) -> DataFrame:
    """Parent joined to its children (``inner``, ``left`` or ``full``), keeping every pair.

    Result: all parent columns, ``parent_found``, all child columns, ``child_found``. Column
    names of the two sides must differ. Copies of a hot parent that met no child in their salt
    are removed; a hot parent always has children, so the pair rows stand for it. A given ``hot``
    must keep that promise for ``left`` and ``full``. Rows with a NULL key match nothing and are
    spread on both sides: children by ``spread_by``, parents by ``parent_spread_by`` (columns the
    result needs anyway) and their partition, so that no other column is read for it.
    """
    hot = _hot(child, fk, policy, hot)
    zero, apart = F.lit(0).cast("long"), scatter([pk, *parent_spread_by])
    found_parent, found_child = F.lit(True).alias("parent_found"), F.lit(True).alias("child_found")
    if hot is None:
        spread = F.when(F.col(fk).isNull(), scatter(spread_by)).otherwise(zero)
        many = child.select("*", found_child, spread.alias("_salt"))
        part = F.when(F.col(pk).isNull(), apart).otherwise(_always_zero(F.col(pk)))
        one = parent.select("*", found_parent, F.lit(False).alias("_copied"), part.alias("_part"))
    else:
        salt = F.coalesce(F.pmod(scatter(spread_by), F.col("n_salts").cast("long")), zero)
        copies = F.when(F.col(pk).isNull(), F.array(apart)).otherwise(
            F.sequence(zero, F.coalesce(F.col("n_salts") - 1, F.lit(0)).cast("long")))
        many = (child.join(F.broadcast(hot), F.col(fk) == F.col("hot_key"), "left")
                .select(*child.columns, found_child,
                        F.when(F.col(fk).isNull(), scatter(spread_by)).otherwise(salt).alias("_salt")))
        one = (parent.join(F.broadcast(hot), F.col(pk) == F.col("hot_key"), "left")
               .select(*parent.columns, found_parent, F.col("hot_key").isNotNull().alias("_copied"),
                       F.explode(copies).alias("_part")))
    joined = one.join(many, (F.col(pk) == F.col(fk)) & (F.col("_part") == F.col("_salt")), how)
    if hot is not None and how in ("left", "full"):
        joined = joined.where(~(F.coalesce(F.col("_copied"), F.lit(False)) & F.col("child_found").isNull()))
    return joined.select(
        *parent.columns, F.coalesce("parent_found", F.lit(False)).alias("parent_found"),
        *child.columns, F.coalesce("child_found", F.lit(False)).alias("child_found"))
