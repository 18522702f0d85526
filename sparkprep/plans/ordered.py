"""Row-ordered operators without a single-partition window.

pandas operators (ffill, shift, rolling, ...) follow the row order of one
frame.  The Spark form of "row order" is an explicit total order
(``order_by`` columns plus, optionally, series keys in ``partition_by``).  A
plain ``Window.orderBy(...)`` without keys moves every row into one task, and
a keyed window puts a hot key (a third of the rows) into one task.  The
helpers here avoid both:

* **range buckets** – boundary tuples are taken from a sample of the sort tuple
  ``(partition_by..., order_by...)``; a row's bucket is found by binary search in
  a sorted array that is broadcast, so it is a pure expression of the row.  Up
  to ``ONE_LEVEL`` buckets need one array.  More need two levels: the square
  root of them as coarse ranges, and for each range the array of its own
  boundaries, taken in Spark from a second sample and written once.  The number
  of buckets follows the rows (``ROWS_PER_BUCKET``), and every bucket gets a
  shuffle partition of its own once there are more than the session has.
* **row index** – bucket sizes (one row each) give offsets; ``idx`` = offset +
  ``row_number`` inside the bucket.
* **halo windows** – rows are grouped into chunks of ``C`` consecutive indices;
  a row is copied into the neighbouring chunk when it lies within the frame
  reach of the chunk edge, the window runs per ``(chunk, keys)`` and only home
  rows are kept.  Any frame ``[-a, +b]`` with ``a + b <= C`` is exact.
* **carry** – forward/backward fill runs inside each bucket; the value that
  crosses a bucket edge comes from a per-(bucket, key) table of last/first
  non-null values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, default_parallelism

ROWS_PER_BUCKET = 1 << 20
ONE_LEVEL = 512             # buckets that one boundary array serves
MAX_BUCKETS = 1 << 20       # bounds the broadcast boundaries; beyond 10^12 rows the buckets grow instead
SAMPLE_PER_BUCKET = 64      # sample rows per bucket used to choose boundaries
DEFAULT_CHUNK_ROWS = 1 << 20


def _as_list(x):
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def _sort_key(t):
    """Sort key of a sampled tuple in Spark's ascending order (nulls first, NaN last)."""
    return tuple((0 if v is None else 2 if v != v else 1, v if v is not None and v == v else 0) for v in t)


def choose_buckets(df: DataFrame, rows: int, n_buckets: int | None = None) -> int:
    want = n_buckets or max(default_parallelism(df.sparkSession), -(-rows // ROWS_PER_BUCKET))
    return max(1, min(MAX_BUCKETS, want))


def _search(df: DataFrame, edges: str, name: str, longest: int) -> DataFrame:
    """``name`` = number of elements of the sorted array ``edges`` (of at most ``longest``) that are <= ``__key``.

    One projection a step, all in one stage of generated code; a place beyond
    the array (or a missing array) reads as null and adds nothing."""
    steps = [1 << j for j in range(longest.bit_length() - 1, -1, -1)]
    df = df.withColumn(name, F.lit(0))
    for step in steps:
        df = df.withColumn(name, F.col(name) + F.when(F.col("__key") >= F.get(F.col(edges), F.col(name) + (step - 1)), step).otherwise(0))
    return df


_LONGEST = 1023             # elements of a boundary array at most


def coarse_edges(df: DataFrame, sort_cols, rows: int, n_buckets: int) -> list:
    """Sorted boundary tuples, at most ``n_buckets - 1``, from a bounded sample."""
    want = min(rows, n_buckets * SAMPLE_PER_BUCKET)
    keys = sorted((tuple(r) for r in df.select(*sort_cols).sample(False, min(1.0, 1.2 * want / rows), 17).collect()), key=_sort_key)
    out = []
    for i in range(1, n_buckets if keys else 0):
        k = keys[min(len(keys) - 1, int(i * len(keys) / n_buckets))]
        if not out or _sort_key(k) > _sort_key(out[-1]):
            out.append(k)
    return out


def _fine_edges(coarse: DataFrame, rows: int, n_buckets: int, per_range: int) -> DataFrame:
    """(__c, __fine): the boundaries inside each coarse range, written once so that every use sees the same ones."""
    share = min(1.0, 1.2 * n_buckets * SAMPLE_PER_BUCKET / rows)
    got = coarse.select("__c", "__key").sample(False, share, 29).groupBy("__c").agg(F.sort_array(F.collect_list("__key")).alias("s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(per_range - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / per_range).cast("int")))
    return cut_lineage(got.select("__c", F.array_distinct(F.filter(at, lambda x: x.isNotNull())).alias("__fine")))


def with_bucket(df: DataFrame, order_by, partition_by=None, n_buckets: int | None = None,
                name: str = "__bucket") -> DataFrame:
    return _bucketed(df, order_by, partition_by, n_buckets, name)[0]


def _bucketed(df: DataFrame, order_by, partition_by=None, n_buckets: int | None = None, name: str = "__bucket"):
    """(``df`` with its range bucket, number of rows).  Bucket numbers ascend with the sort tuple; some may be unused."""
    sort_cols = _as_list(partition_by) + _as_list(order_by)
    rows = df.count()
    buckets = choose_buckets(df, rows, n_buckets)
    if buckets == 1 or rows == 0:
        return df.withColumn(name, F.lit(0).cast("long")), rows
    ranges = buckets if buckets <= ONE_LEVEL else min(_LONGEST + 1, math.isqrt(buckets - 1) + 1)
    edges = coarse_edges(df, sort_cols, rows, ranges)
    kinds = ", ".join(f"k{i}: {df.schema[c].dataType.simpleString()}" for i, c in enumerate(sort_cols))
    one = df.sparkSession.createDataFrame([(0, edges)], f"__one int, __edges array<struct<{kinds}>>")
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(sort_cols)])
    out = df.withColumns({"__key": key, "__one": F.lit(0)}).join(F.broadcast(one), "__one")
    out = _search(out, "__edges", "__c", len(edges)).drop("__edges", "__one")
    number = F.col("__c").cast("long")
    if buckets > ONE_LEVEL:
        per_range = min(_LONGEST + 1, -(-buckets // (len(edges) + 1)))
        fine = _fine_edges(out, rows, buckets, per_range)
        out = _search(out.join(F.broadcast(fine), "__c", "left"), "__fine", "__f", per_range)
        number = F.col("__c").cast("long") * (_LONGEST + 1) + F.col("__f")
    out = out.withColumn(name, number).select(*[F.col(c) for c in df.columns], name)
    return _spread(out, rows, name), rows


def _spread(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """One partition for about ``ROWS_PER_BUCKET`` rows, where the session's shuffle partitions would hold more."""
    parts = min(MAX_BUCKETS, -(-rows // ROWS_PER_BUCKET))
    return df.repartition(parts, *cols) if parts > default_parallelism(df.sparkSession) else df


def with_row_index(df: DataFrame, order_by, partition_by=None, n_buckets: int | None = None,
                   name: str = "__idx", keep_bucket: bool = False) -> DataFrame:
    """Global 0-based row index in ``(partition_by, order_by)`` order (a total order).

    ``keep_bucket`` keeps the range bucket (``__bucket``) of every row."""
    return _indexed(df, order_by, partition_by, n_buckets, name, keep_bucket)[0]


def _indexed(df: DataFrame, order_by, partition_by, n_buckets, name: str, keep_bucket: bool = False):
    sort_cols = _as_list(partition_by) + _as_list(order_by)
    b, rows = _bucketed(df, order_by, partition_by, n_buckets)
    sizes = b.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # one row a bucket: the running offset is a small single-task window
    offsets = sizes.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n"))
                           .alias("__off"))
    w = Window.partitionBy("__bucket").orderBy(*sort_cols)
    out = (b.join(F.broadcast(offsets), "__bucket")
           .withColumn(name, F.col("__off") + F.row_number().over(w) - 1)
           .drop("__off"))
    return (out if keep_bucket else out.drop("__bucket")), rows


def series_index(df: DataFrame, order_by, partition_by=None, n_buckets: int | None = None,
                 name: str = "__pos", size_name: str | None = None, id_name: str | None = None, ends: tuple | None = None) -> DataFrame:
    """0-based position inside each series (global index minus the series start).

    ``size_name`` also adds the number of rows of the row's series, ``id_name``
    a number of the series (the index of its first row), and ``ends`` =
    (column, first, last) the column's smallest and largest value in the series."""
    keys = _as_list(partition_by)
    extra = [c for c in (size_name, id_name, *(ends or ())[1:]) if c]
    if not keys:
        out = with_row_index(df, order_by, None, n_buckets, name)
        if id_name:
            out = out.withColumn(id_name, F.lit(0).cast("long"))
        aggs = [F.count(F.lit(1)).alias(size_name)] if size_name else []
        aggs += [F.min(ends[0]).alias(ends[1]), F.max(ends[0]).alias(ends[2])] if ends else []
        if aggs:
            from ..operators.profile import attach_scalars
            out = attach_scalars(out, df.agg(*aggs))
        return out.select(*[F.col(c) for c in df.columns], name, *extra)
    idx = with_row_index(df, order_by, keys, n_buckets, "__gidx", keep_bucket=True)
    # What a series has in common reaches its rows through a (bucket, key) table:
    # at most buckets + series rows, and a hot series is spread over many
    # buckets, so neither this join nor the per-key window (<= buckets rows)
    # meets a hot key.
    edge = [F.min(ends[0]).alias("__e0"), F.max(ends[0]).alias("__e1")] if ends else []
    firsts = idx.groupBy("__bucket", *keys).agg(F.min("__gidx").alias("__bmin"),
                                                F.count(F.lit(1)).alias("__bcnt"), *edge)
    per_key = Window.partitionBy(*keys)
    common = [F.min("__bmin").over(per_key).alias("__start")]
    common += [F.sum("__bcnt").over(per_key).alias(size_name)] if size_name else []
    common += [F.min("__e0").over(per_key).alias(ends[1]), F.max("__e1").over(per_key).alias(ends[2])] if ends else []
    starts = firsts.select(F.col("__bucket").alias("__sb"), *[F.col(k).alias(f"__sk{j}") for j, k in enumerate(keys)], *common)
    cond = [F.col("__bucket") == F.col("__sb")] + [F.col(k).eqNullSafe(F.col(f"__sk{j}"))
                                                  for j, k in enumerate(keys)]
    out = idx.join(starts, cond).withColumn(name, F.col("__gidx") - F.col("__start"))
    if id_name:
        out = out.withColumn(id_name, F.col("__start"))
    return out.select(*[F.col(c) for c in df.columns], name, *extra)


def halo_window(df: DataFrame, order_by, partition_by, before: int, after: int, compute,
                chunk_rows: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """Evaluate window columns over the row frame ``[-before, +after]``.

    ``compute(window_spec) -> dict[name, Column]`` builds the new columns from a
    window partitioned by ``(chunk, keys)`` ordered by the global index (no
    frame: callers add ``rowsBetween(-before, after)`` or use ``lag``/``lead``).
    The result keeps every input row exactly once.
    """
    keys = _as_list(partition_by)
    idx_df, rows = _indexed(df, order_by, keys, n_buckets, "__idx")
    return halo(idx_df, rows, keys, before, after, compute, chunk_rows)


def halo(indexed: DataFrame, rows: int, keys, before: int, after: int, compute, chunk_rows: int | None = None) -> DataFrame:
    """``halo_window`` over ``rows`` rows that have their global index ``__idx`` already."""
    c = max(chunk_rows or DEFAULT_CHUNK_ROWS, 2 * (before + after) + 1)
    idx = F.col("__idx")
    first_chunk = F.floor((idx - after) / c)
    last_chunk = F.floor((idx + before) / c)
    rep = (indexed.withColumn("__home", F.floor(idx / c))
           .withColumn("__chunk", F.explode(F.sequence(F.greatest(first_chunk, F.lit(0)).cast("long"),
                                                       last_chunk.cast("long")))))
    rep = _spread(rep, rows, "__chunk")
    w = Window.partitionBy("__chunk", *keys).orderBy("__idx")
    out = rep.withColumns(compute(w)).where(F.col("__chunk") == F.col("__home"))
    return out.drop("__chunk", "__home")


def fill(df: DataFrame, cols, order_by, partition_by=None, direction: str = "forward",
         n_buckets: int | None = None) -> DataFrame:
    """Forward (``ffill``), backward (``bfill``) or forward-then-backward (``both``) fill in row order, per series.

    Inside each range bucket a running ``last`` ignoring nulls, over the reversed
    order to fill backward: a frame that starts at the first row grows by one row
    a step, one that ends at the last row is read again for every row.  The value
    entering a bucket is carried from a table with one row per (bucket, key) –
    ``P`` rows when there are no keys.  What is still null after a forward fill
    precedes the first value of its series, so ``both`` takes that value from the
    same table.
    """
    keys = _as_list(partition_by)
    order = _as_list(order_by)
    cols = _as_list(cols)
    both = direction == "both"
    fwd = both or direction in ("forward", "ffill")
    b = with_bucket(df, order, keys, n_buckets)
    sort_t = F.struct(*[F.col(c) for c in order])
    way = (lambda c: F.col(c).asc()) if fwd else (lambda c: F.col(c).desc())
    w_in = Window.partitionBy("__bucket", *keys).orderBy(*[way(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    edge_aggs = []
    for i, c in enumerate(cols):
        ordered_val = F.when(F.col(c).isNotNull(), sort_t)
        edge_aggs.append((F.max_by(F.col(c), ordered_val) if fwd else F.min_by(F.col(c), ordered_val))
                         .alias(f"__e{i}"))
        if both:
            edge_aggs.append(F.min_by(F.col(c), ordered_val).alias(f"__f{i}"))
    edges = b.groupBy("__bucket", *keys).agg(*edge_aggs)
    renamed = {"__bucket": "__cb", **{k: f"__ck{j}" for j, k in enumerate(keys)}}
    w_carry = Window.partitionBy(*keys).orderBy(way("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = [F.last(f"__e{i}", ignorenulls=True).over(w_carry) for i in range(len(cols))]
    if both:
        carried = [F.coalesce(k, F.first(f"__f{i}", ignorenulls=True).over(w_all)) for i, k in enumerate(carried)]
    carry = edges.select(*[F.col(a).alias(b_) for a, b_ in renamed.items()], *[k.alias(f"__k{i}") for i, k in enumerate(carried)])
    filled = b.withColumns({c: F.last(F.col(c), ignorenulls=True).over(w_in) for c in cols})
    cond = [F.col("__bucket") == F.col("__cb")] + [F.col(k).eqNullSafe(F.col(f"__ck{j}"))
                                                  for j, k in enumerate(keys)]
    joined = filled.join(carry, cond, "left")
    out = []
    for c in df.columns:
        if c in cols:
            out.append(F.coalesce(F.col(c), F.col(f"__k{cols.index(c)}")).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)
