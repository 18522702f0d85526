"""Exact quantiles without a single-task value map (A-01, A-04, A-11, D-03, O-01, E-07, C-03, N-05).

``percentile`` (exact) keeps a value→count map per column and merges it in
one final task: at 100 TB a high-cardinality column would put every distinct
value into that task.  Exact linear-interpolation quantiles are found here by
distributed selection, for all columns and probabilities (and, grouped, for
all groups) together, on one path at every size:

1. One aggregate counts the values and sketches them (``percentile_approx``, a
   mergeable sketch).  The sketch is read at p ± δ for a ladder of δ; the
   narrowest that spans some ranks gives a bracket around each target.
2. One aggregate counts, per target, the rows below, at both edges of and
   inside its bracket, and gathers the values inside while they are expected to
   be few.  A rank that falls on an edge value is that value, however many rows
   share it; one inside is read off the sorted values.

Larger brackets repeat 1–2 within themselves (a global quantile) or number
their rows by range buckets (a group), as does a target that the sketch missed.
NaN counts as missing, as in pandas.

Interpolation is ``lo + (hi − lo)·frac`` as in SQL ``quantile_cont``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import q

ACCURACY = 10000
MAX_CANDIDATES = 100000
#: Groups whose brackets are broadcast; more meet their rows in a salted join, a slice of ``SLICE_ROWS`` rows of a group in a task.
BROADCAST_GROUPS, SLICE_ROWS = 200_000, 1 << 20
#: Values of a group that are gathered in one row.
GROUP_CANDIDATES = 1 << 20


def _ladder(accuracy: int) -> list:
    """Half widths of brackets, as shares of the ranks."""
    return [d for d in (2.0 / accuracy * 4 ** j for j in range(12)) if d < 0.5]


def present(col: str):
    """The column as double, NaN as null."""
    return F.nanvl(F.col(q(col)).cast("double"), F.lit(None).cast("double"))


class _Target:
    """An open rank of a column: the ``inside`` rows strictly between ``lo`` and ``hi`` (None: no edge) follow ``below`` others."""

    def __init__(self, col, rank, inside):
        self.col, self.rank, self.inside, self.below, self.lo, self.hi, self.step = col, rank, inside, 0, None, None, 0


def _between(x, lo, hi):
    cond = x.isNotNull()
    if lo is not None:
        cond = cond & (x > F.lit(lo))
    if hi is not None:
        cond = cond & (x < F.lit(hi))
    return cond


def _narrowest(deltas: list, n: int, step: int = 0):
    """Index of the narrowest half width that spans three of ``n`` ranks, ``step`` places wider; None if none does."""
    j = next((j for j, d in enumerate(deltas) if d * n >= 3), len(deltas)) + step
    return j if j < len(deltas) else None


def order_statistics(df: DataFrame, cols: list, probs, accuracy: int = ACCURACY, max_candidates: int = MAX_CANDIDATES) -> tuple:
    """({column: number of values}, {(column, 0-based rank): value}) for the two ranks around each probability of each column."""
    xs = {c: present(c) for c in cols}
    deltas, at = _ladder(accuracy), {}
    for p in probs:
        for j, d in enumerate(deltas):
            at[(p, j)] = (max(0.0, p - d), min(1.0, p + d))
    places = [x for pair in at.values() for x in pair]
    first = df.agg(*[F.count(xs[c]).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[F.percentile_approx(xs[c], F.array(*[F.lit(x) for x in places]), accuracy).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    sizes, edges, targets, result = {}, {}, {}, {}
    for i, c in enumerate(cols):
        n = sizes[c] = first[f"n{i}"]
        for p in probs if n else ():
            j = _narrowest(deltas, n)
            pair = (None, None) if j is None else tuple(first[f"s{i}"][2 * list(at).index((p, j)) + e] for e in (0, 1))
            for rank in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}:
                if (c, rank) not in targets:
                    targets[(c, rank)] = _Target(c, rank, n)
                    edges[(c, rank)] = (*pair, n if j is None else int(2 * deltas[j] * n) + 1)
    while targets:
        # brackets that several ranks share are counted once; the smallest are gathered while they fit together
        shared = {}
        for key, (lo, hi, size) in edges.items():
            shared.setdefault((key[0], lo, hi), [size, []])[1].append(key)
        room, aggs = max_candidates, []
        for t, ((c, lo, hi), (size, keys)) in enumerate(sorted(shared.items(), key=lambda kv: kv[1][0])):
            x, none = xs[c], F.lit(0).cast("long")
            aggs += [F.count_if(x < F.lit(lo)).alias(f"u{t}") if lo is not None else F.max(none).alias(f"u{t}"),
                     F.count_if(x == F.lit(lo)).alias(f"l{t}") if lo is not None else F.max(none).alias(f"l{t}"),
                     F.count_if(_between(x, lo, hi)).alias(f"w{t}"),
                     F.count_if(x == F.lit(hi)).alias(f"h{t}") if hi is not None and hi != lo else F.max(none).alias(f"h{t}")]
            if size <= room:
                room -= size
                aggs.append(F.collect_list(F.when(_between(x, lo, hi), x)).alias(f"v{t}"))
        got = df.agg(*aggs).first().asDict()
        for t, ((c, lo, hi), (_, keys)) in enumerate(sorted(shared.items(), key=lambda kv: kv[1][0])):
            values = sorted(got[f"v{t}"]) if f"v{t}" in got else None
            up = got[f"u{t}"] + got[f"l{t}"]
            for key in keys:
                k, target = key[1], targets[key]
                if got[f"u{t}"] <= k < up:
                    result[key] = lo
                elif up <= k < up + got[f"w{t}"]:
                    target.lo, target.hi, target.below, target.inside, target.step = lo, hi, up, got[f"w{t}"], 0
                    if values is not None:
                        result[key] = values[k - up]
                elif up + got[f"w{t}"] <= k < up + got[f"w{t}"] + got[f"h{t}"]:
                    result[key] = hi
                else:  # the sketch missed the rank: a wider bracket of the old one
                    target.step += 1
        targets = {key: t for key, t in targets.items() if key not in result}
        edges = _new_edges(df, xs, targets, deltas, accuracy, max_candidates)
    return sizes, result


def _new_edges(df: DataFrame, xs: dict, targets: dict, deltas: list, accuracy: int, max_candidates: int) -> dict:
    """Brackets within the open ones, from a sketch of their rows alone; a bracket that is small enough stays as it is."""
    edges, asked = {}, {}
    for key, t in targets.items():
        j = _narrowest(deltas, t.inside, t.step)
        if t.inside <= max_candidates or j is None:
            edges[key] = (t.lo, t.hi, t.inside if t.inside <= max_candidates or j is not None else 0)
        else:
            local = (key[1] - t.below) / max(t.inside - 1, 1)
            asked.setdefault((key[0], t.lo, t.hi), {})[key] = (max(0.0, local - deltas[j]), min(1.0, local + deltas[j]), int(2 * deltas[j] * t.inside) + 1)
    if asked:
        got = df.agg(*[F.percentile_approx(F.when(_between(xs[c], lo, hi), xs[c]), F.array(*[F.lit(p) for v in keys.values() for p in v[:2]]), accuracy)
                       .alias(f"s{i}") for i, ((c, lo, hi), keys) in enumerate(asked.items())]).first()
        for i, keys in enumerate(asked.values()):
            for j, (key, v) in enumerate(keys.items()):
                edges[key] = (got[f"s{i}"][2 * j], got[f"s{i}"][2 * j + 1], v[2])
    return edges


def exact_quantiles(df: DataFrame, cols, probs, **kw) -> dict:
    """{col: [quantile per prob]} with linear interpolation (None for an all-null column)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    sizes, stats = order_statistics(df, cols, list(probs), **kw)
    out = {}
    for c in cols:
        out[c] = []
        for p in probs:
            h = (sizes[c] - 1) * p
            a, b = (stats[(c, k)] if sizes[c] else None for k in (math.floor(h), math.ceil(h)))
            out[c].append(a if a is None or a == b else a + (b - a) * (h - math.floor(h)))
    return out


def quantile_frame(df: DataFrame, cols, probs, names=None, **kw) -> DataFrame:
    """One-row frame ``{col}_{name}`` of exact quantiles."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    qs = exact_quantiles(df, cols, probs, **kw)
    fields, values = [], []
    for c in cols:
        for nm, v in zip(names, qs[c]):
            fields.append(f"{q(f'{c}_{nm}')} double")
            values.append(None if v is None else float(v))
    return df.sparkSession.createDataFrame([tuple(values)], ", ".join(fields))


def grouped_quantiles(df: DataFrame, keys, col: str, probs, names=None) -> DataFrame:
    """Exact per-group linear-interpolation quantiles of ``col``: ``keys + names``.

    Groups whose values are all null are absent (callers join the result to their group table)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    out = grouped_statistics(df, keys, {col: [*zip(probs, names)]}, [F.count(present(col)).alias("__n")])
    return out.where("__n > 0").drop("__n")


def grouped_statistics(df: DataFrame, keys, wanted: dict, others=(), accuracy: int = ACCURACY) -> DataFrame:
    """One row per group without null keys: ``keys``, the aggregates ``others``, and for ``wanted`` = {column: [(probability, name)]}
    the exact quantiles of all columns, from two scans together.

    No group is ever held by one task: the first scan is a partial aggregate with mergeable sketches, the second counts against the
    brackets and gathers at most ``GROUP_CANDIDATES`` values of a group.  Brackets reach the rows by a broadcast of a counted
    size, or by a join salted after the first scan's counts.  Both aggregates are written to the shared checkpoint folder."""
    from ..session import cut_lineage

    keys = [keys] if isinstance(keys, str) else list(keys)
    gk = [f"__g{j}" for j in range(len(keys))]
    kept = df.where(" AND ".join(f"{q(k)} IS NOT NULL" for k in keys))
    cols, deltas = list(wanted), _ladder(accuracy)
    x = [f"__x{i}" for i in range(len(cols))]
    probs = {i: sorted({p for p, _ in wanted[c]}) for i, c in enumerate(cols)}
    sketch = [F.percentile_approx(present(c), F.array(*[F.lit(min(1.0, max(0.0, p + e * d))) for p in probs[i] for d in deltas for e in (-1, 1)]), accuracy)
              .alias(f"__s{i}") for i, c in enumerate(cols)]
    counts = [F.count(present(c)).alias(f"__n{i}") for i, c in enumerate(cols)]
    stats = cut_lineage(kept.groupBy(*[F.col(q(k)).alias(g) for k, g in zip(keys, gk)]).agg(*others, *counts, *sketch))

    targets = [(f"{i}_{j}", i, p, j) for i in probs for j, p in enumerate(probs[i])]
    edge = []
    for t, i, _, j in targets:
        for e, side in enumerate(("lo", "hi")):
            at = F.lit(None).cast("double")
            for m in range(len(deltas) - 1, -1, -1):
                at = F.when(F.col(f"__n{i}") * deltas[m] >= 3, F.get(f"__s{i}", F.lit(2 * (j * len(deltas) + m) + e))).otherwise(at)
            edge.append(at.alias(f"__{side}{t}"))
    own = [c for c in stats.columns if not c.startswith("__") or c == "__n"]
    stats = stats.select(*gk, *own, *[f"__n{i}" for i in range(len(cols))], *edge)
    brackets = stats.drop(*own)
    rows = kept.select(*[F.col(q(k)).alias(g) for k, g in zip(keys, gk)], *[present(c).alias(a) for c, a in zip(cols, x)])
    met = _meet(rows, brackets, gk, x)

    def inside(t, i):
        lo, hi = F.col(f"__lo{t}"), F.col(f"__hi{t}")
        return F.col(x[i]).isNotNull() & (lo.isNull() | (F.col(x[i]) > lo)) & (hi.isNull() | (F.col(x[i]) < hi))

    few = {t: F.col(f"__n{i}") * (4 * deltas[0]) <= GROUP_CANDIDATES for t, i, *_ in targets}
    aggs = []
    for t, i, *_ in targets:
        v, lo, hi = F.col(x[i]), F.col(f"__lo{t}"), F.col(f"__hi{t}")
        aggs += [F.count_if(v < lo).alias(f"__u{t}"), F.count_if(v == lo).alias(f"__l{t}"), F.count_if(inside(t, i)).alias(f"__w{t}"),
                 F.count_if((v == hi) & (hi > lo)).alias(f"__h{t}"), F.sort_array(F.collect_list(F.when(inside(t, i) & few[t], v))).alias(f"__v{t}")]
    picked = stats.join(met.groupBy(*gk).agg(*aggs), gk)
    for t, i, p, _ in targets:
        h = F.lit(float(p)) * (F.col(f"__n{i}") - 1)
        for name, k in ((f"__a{t}", F.floor(h)), (f"__b{t}", F.ceil(h))):
            picked = picked.withColumn(name, _pick(t, k, few[t]))
    picked = cut_lineage(picked.drop(*[f"__v{t}" for t, *_ in targets]))
    left = [(t, i, p, e, f) for t, i, p, _ in targets for e, f in (("a", F.floor), ("b", F.ceil))]
    missing = {(t, e): (F.col(f"__n{i}") > 0) & F.col(f"__{e}{t}").isNull() for t, i, _, e, _ in left}
    open_ = picked.agg(*[F.count_if(c).alias(f"{t}{e}") for (t, e), c in missing.items()]).first()
    if any(open_):
        picked = _by_index(rows, picked, [(t, i, p, e, f) for t, i, p, e, f in left if open_[f"{t}{e}"]], missing, gk, x)

    values = []
    for i, c in enumerate(cols):
        for p, name in wanted[c]:
            t = next(t for t, a, b, _ in targets if (a, b) == (i, p))
            h = F.lit(float(p)) * (F.col(f"__n{i}") - 1)
            lo, hi = F.col(f"__a{t}"), F.col(f"__b{t}")
            values.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return picked.select(*[F.col(g).alias(k) for g, k in zip(gk, keys)], *own, *values)


def _pick(t: str, k, few):
    """The value of rank ``k`` of a group; null if it is not known."""
    u, up, w = F.col(f"__u{t}"), F.col(f"__u{t}") + F.col(f"__l{t}"), F.col(f"__w{t}")
    return (F.when(k < u, F.lit(None)).when(k < up, F.col(f"__lo{t}"))
            .when(k < up + w, F.when(few, F.get(f"__v{t}", (k - up).cast("int"))))
            .when(k < up + w + F.col(f"__h{t}"), F.col(f"__hi{t}")))


def _meet(rows: DataFrame, brackets: DataFrame, gk: list, x: list) -> DataFrame:
    """Each row with the brackets of its group."""
    most = F.greatest(*[F.col(f"__n{i}") for i in range(len(x))], F.lit(0))
    if brackets.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(brackets), gk)
    slices = F.ceil(most / SLICE_ROWS).cast("int")
    hot = brackets.where(slices > 1).select(*gk, slices.alias("__of"))  # at most one in SLICE_ROWS of the rows
    salted = (rows.join(F.broadcast(hot), gk, "left")
              .withColumn("__salt", F.pmod(F.xxhash64(*x), F.coalesce("__of", F.lit(1))).cast("int")).drop("__of"))
    copies = brackets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(slices, F.lit(1)) - 1)))
    return salted.join(copies, [*gk, "__salt"]).drop("__salt")


def _by_index(rows: DataFrame, picked: DataFrame, left: list, missing: dict, gk: list, x: list) -> DataFrame:
    """The open ranks of ``picked``, by numbering the rows inside their brackets (of the whole group, where the sketch missed) in range buckets."""
    from ..plans.ordered import with_row_index
    from ..session import cut_lineage

    asked = []
    for no, (t, i, p, e, rank) in enumerate(left):
        k, up = rank(F.lit(float(p)) * (F.col(f"__n{i}") - 1)), F.col(f"__u{t}") + F.col(f"__l{t}")
        hit = (k >= up) & (k < up + F.col(f"__w{t}"))
        lo, hi = (F.when(hit, F.col(f"__{s}{t}")) for s in ("lo", "hi"))
        asked.append(picked.where(missing[(t, e)]).select(*gk, F.lit(no).alias("__no"), F.lit(i).alias("__col"), lo.alias("__lo"), hi.alias("__hi"),
                                                          (k - F.when(hit, up).otherwise(0)).cast("long").alias("__k")))
    table = asked[0]
    for a in asked[1:]:
        table = table.unionByName(a)
    table = cut_lineage(table)
    value = F.element_at(F.array(*x), F.col("__col") + 1)
    inside = (value.isNotNull() & (F.col("__lo").isNull() | (value > F.col("__lo"))) & (F.col("__hi").isNull() | (value < F.col("__hi"))))
    few = table.count() <= BROADCAST_GROUPS
    candidates = rows.join(F.broadcast(table) if few else table, gk).where(inside).select(*gk, "__no", value.alias("__x"), "__k")
    idx = cut_lineage(with_row_index(candidates, ["__x"], [*gk, "__no"], name="__i"))
    starts = idx.groupBy(*gk, "__no").agg((F.min("__i") + F.first("__k")).alias("__i"))
    found = (starts.join(idx.select("__i", "__x"), "__i")
             .groupBy(*gk).agg(*[F.max(F.when(F.col("__no") == no, F.col("__x"))).alias(f"__r{no}") for no in range(len(left))]))
    out = picked.join(found, gk, "left")
    for no, (t, _, _, e, _) in enumerate(left):
        out = out.withColumn(f"__{e}{t}", F.coalesce(f"__{e}{t}", f"__r{no}"))
    return out
