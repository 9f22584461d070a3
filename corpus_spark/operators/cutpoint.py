"""Exact weighted cut points without a global sort.

Problem: order rows by ``(metric, id)`` (NULL metrics last) and find the
first row at which the running sum of ``weight`` exceeds a budget; everything
before it is the "low" side.  The reference does this with argsort + cumsum
on one machine.  A ``Window.orderBy`` without ``partitionBy`` would put the
whole table in one task, so instead we narrow the search range on the driver
using small per-bucket aggregates:

1. one aggregate gives, per group, min/max of the metric and the weights of
   non-NULL and NULL rows;
2. each round buckets the rows of the current range with ``width_bucket``
   (native, codegen'd), aggregates ``count, sum(weight), min, max`` per
   bucket (at most ``BUCKETS`` rows per group reach the driver) and keeps the
   bucket where the running sum crosses the budget;
3. once the crossing bucket holds a single metric value the same search runs
   on ``id`` inside that value; once it is small (``SMALL`` rows) its keys are
   fetched and walked exactly.

The result per group is the first *excluded* key ``(m_x, id_x)``; the low side
is ``(m, id) < (m_x, id_x)``.  Work per round is one scan of the (persisted)
key table; the number of rounds is logarithmic in the value range.  Groups
(e.g. languages) are searched simultaneously; their number bounds everything
that reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
SMALL = 4096
MAX_ROUNDS = 200


@dataclass
class _State:
    budget: float
    below: float = 0.0
    phase: str = "m"            # "m": searching the metric; "id": inside one metric value
    lo: float | int | None = None
    hi: float | int | None = None
    value: float | None = None  # fixed metric value during the id phase
    value_null: bool = False
    done: bool = False
    cut: tuple | None = None    # (m_x, m_x_is_null, id_x) or None = everything is low
    extra: dict = field(default_factory=dict)


def _gkey(row, group_cols):
    return tuple(row[g] for g in group_cols)


def _group_filter(group_cols, key) -> Column:
    cond = F.lit(True)
    for g, v in zip(group_cols, key):
        cond = cond & (F.col(g).eqNullSafe(F.lit(v)))
    return cond


def find_cuts(keys: DataFrame, metric: str, id_col: str, weight: str | None,
              budgets, group_cols: list[str] | None = None) -> dict:
    """Return ``{group_key: cut}`` where ``cut`` is ``None`` (every row is low)
    or ``(m_x, m_x_is_null, id_x)`` (first excluded row).

    ``budgets`` is a number (same for all groups) or a dict keyed by group
    tuple.  ``keys`` should already be projected to the needed columns and
    persisted by the caller when it is expensive to recompute.
    """
    group_cols = list(group_cols or [])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    k = keys.select(*[F.col(g) for g in group_cols], F.col(metric).cast("double").alias("__m"),
                    F.col(id_col).cast("long").alias("__id"), w.alias("__w"))

    first = (k.groupBy(*group_cols)
             .agg(F.min("__m").alias("mn"), F.max("__m").alias("mx"),
                  F.coalesce(F.sum(F.when(F.col("__m").isNotNull(), F.col("__w")).otherwise(0.0)),
                             F.lit(0.0)).alias("w_nn"),
                  F.coalesce(F.sum(F.when(F.col("__m").isNull(), F.col("__w")).otherwise(0.0)),
                             F.lit(0.0)).alias("w_null"),
                  F.min(F.when(F.col("__m").isNull(), F.col("__id"))).alias("nid_lo"),
                  F.max(F.when(F.col("__m").isNull(), F.col("__id"))).alias("nid_hi"))
             .collect())
    states: dict[tuple, _State] = {}
    for r in first:
        key = _gkey(r, group_cols)
        b = float(budgets[key] if isinstance(budgets, dict) else budgets)
        st = _State(budget=b)
        if r["w_nn"] + r["w_null"] <= b:
            st.done, st.cut = True, None
        elif r["w_nn"] > b:
            st.lo, st.hi = r["mn"], r["mx"]
        else:  # cut falls inside the NULL-metric rows
            st.phase, st.value_null, st.below = "id", True, r["w_nn"]
            st.lo, st.hi = r["nid_lo"], r["nid_hi"]
        states[key] = st

    for _ in range(MAX_ROUNDS):
        todo = {key: st for key, st in states.items() if not st.done}
        if not todo:
            return {key: st.cut for key, st in states.items()}
        # One aggregation job per phase covering all pending groups.
        for phase in ("m", "id"):
            pend = {key: st for key, st in todo.items() if st.phase == phase}
            if pend:
                _round(k, group_cols, pend, phase)
    raise RuntimeError("cut-point search did not converge")


def _range_frame(k: DataFrame, group_cols, pend: dict, phase: str) -> DataFrame:
    """Rows of every pending group inside its current range, with a bucket id."""
    spark = k.sparkSession
    rows = []
    for key, st in pend.items():
        if phase == "m":
            step = 0
            rows.append(list(key) + [float(st.lo), float(st.hi), False, 0.0, 0, 0, 0])
        else:
            lo, hi = int(st.lo), int(st.hi)
            step = max(1, -(-(hi - lo + 1) // BUCKETS))
            rows.append(list(key) + [0.0, 0.0, bool(st.value_null),
                                     float(st.value) if st.value is not None else 0.0, step, lo, hi])
            st.extra["step"] = step
    schema = ", ".join([f"`{g}` {dict(k.dtypes)[g]}" for g in group_cols]
                       + ["__lo double", "__hi double", "__vnull boolean", "__v double", "__step long",
                          "__ilo long", "__ihi long"])
    if group_cols:
        st_df = spark.createDataFrame(rows, schema)
        # The state table has one row per pending group (bounded by the number of groups).
        j = k.join(F.broadcast(st_df), on=group_cols, how="inner") if len(rows) <= 100_000 \
            else k.join(st_df, on=group_cols, how="inner")
    else:
        r = rows[0]
        j = k.select("*", F.lit(r[0]).alias("__lo"), F.lit(r[1]).alias("__hi"),
                     F.lit(r[2]).alias("__vnull"), F.lit(r[3]).alias("__v"),
                     F.lit(r[4]).cast("long").alias("__step"), F.lit(r[5]).cast("long").alias("__ilo"),
                     F.lit(r[6]).cast("long").alias("__ihi"))
    if phase == "m":
        j = j.filter(F.col("__m").between(F.col("__lo"), F.col("__hi")))
        b = F.when(F.col("__hi") > F.col("__lo"),
                   F.width_bucket(F.col("__m"), F.col("__lo"), F.col("__hi"), F.lit(BUCKETS))) \
            .otherwise(F.lit(1).cast("long"))
    else:
        in_value = F.when(F.col("__vnull"), F.col("__m").isNull()).otherwise(F.col("__m") == F.col("__v"))
        lo_l = F.col("__ilo")
        j = j.filter(in_value & F.col("__id").between(lo_l, F.col("__ihi")))
        b = F.expr("(__id - __ilo) div __step")  # exact integral division
    return j.withColumn("__b", b)


def _round(k: DataFrame, group_cols, pend: dict, phase: str) -> None:
    j = _range_frame(k, group_cols, pend, phase)
    val = "__m" if phase == "m" else "__id"
    stats = (j.groupBy(*group_cols, "__b")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("__w").alias("w"),
                  F.min(val).alias("vmin"), F.max(val).alias("vmax"),
                  F.min("__id").alias("idmin"), F.max("__id").alias("idmax"))
             .collect())
    per_group: dict[tuple, list] = {}
    for r in stats:
        per_group.setdefault(_gkey(r, group_cols), []).append(r)
    small_fetch = []
    for key, st in pend.items():
        buckets = sorted(per_group.get(key, []), key=lambda r: r["__b"])
        cum = st.below
        crossing = None
        for r in buckets:
            if cum + r["w"] > st.budget:
                crossing = r
                break
            cum += r["w"]
        if crossing is None:  # cannot happen while the invariant holds; be safe
            st.done, st.cut = True, None
            continue
        st.below = cum
        if phase == "m" and crossing["vmin"] == crossing["vmax"]:
            st.phase, st.value, st.value_null = "id", crossing["vmin"], False
            st.lo, st.hi = crossing["idmin"], crossing["idmax"]
            if crossing["n"] <= SMALL:
                small_fetch.append((key, st, crossing))
            continue
        if crossing["n"] <= SMALL or crossing["vmin"] == crossing["vmax"]:
            small_fetch.append((key, st, crossing))
        else:
            st.lo, st.hi = crossing["vmin"], crossing["vmax"]
    if small_fetch:
        _finish_small(j, group_cols, small_fetch, phase)


def _finish_small(j: DataFrame, group_cols, items, phase: str) -> None:
    """Fetch the keys of the (bounded) crossing buckets and walk them exactly."""
    cond = F.lit(False)
    for key, st, crossing in items:
        cond = cond | (_group_filter(group_cols, key) & (F.col("__b") == F.lit(crossing["__b"])))
    rows = (j.filter(cond).select(*group_cols, "__m", "__id", "__w").collect())
    per_group: dict[tuple, list] = {}
    for r in rows:
        per_group.setdefault(_gkey(r, group_cols), []).append(r)
    for key, st, crossing in items:
        rs = per_group.get(key, [])
        rs.sort(key=lambda r: (r["__m"] is None, r["__m"] if r["__m"] is not None else 0.0, r["__id"]))
        cum = st.below
        for r in rs:
            cum += r["__w"]
            if cum > st.budget:
                st.cut = (r["__m"], r["__m"] is None, r["__id"])
                break
        st.done = True


def low_predicate(metric: str, id_col: str, cut) -> Column:
    """Predicate of the low side for one cut (no groups)."""
    m, i = F.col(metric).cast("double"), F.col(id_col).cast("long")
    if cut is None:
        return F.lit(True)
    mx, mnull, idx = cut
    if mnull:
        return m.isNotNull() | (m.isNull() & (i < F.lit(idx)))
    return m.isNotNull() & ((m < F.lit(mx)) | ((m == F.lit(mx)) & (i < F.lit(idx))))


def attach_low_flag(df: DataFrame, metric: str, id_col: str, cuts: dict,
                    group_cols: list[str] | None = None, flag: str = "__low") -> DataFrame:
    """Add a boolean column telling whether each row lies before its group's cut."""
    group_cols = list(group_cols or [])
    if not group_cols:
        return df.withColumn(flag, low_predicate(metric, id_col, cuts.get((), None)))
    spark = df.sparkSession
    rows = []
    for key, cut in cuts.items():
        if cut is None:
            rows.append(list(key) + [True, None, False, None])
        else:
            rows.append(list(key) + [False, None if cut[1] else float(cut[0]), bool(cut[1]), int(cut[2])])
    schema = ", ".join([f"`{g}` {dict(df.dtypes)[g]}" for g in group_cols]
                       + ["__all boolean", "__mx double", "__mnull boolean", "__idx long"])
    cut_df = spark.createDataFrame(rows, schema)
    # one row per group: broadcast is bounded by the number of groups
    joined = df.join(F.broadcast(cut_df) if len(rows) <= 100_000 else cut_df, on=group_cols, how="left")
    m, i = F.col(metric).cast("double"), F.col(id_col).cast("long")
    pred = F.when(F.col("__all"), F.lit(True)).when(
        F.col("__mnull"), m.isNotNull() | (m.isNull() & (i < F.col("__idx")))
    ).otherwise(m.isNotNull() & ((m < F.col("__mx")) | ((m == F.col("__mx")) & (i < F.col("__idx")))))
    return joined.withColumn(flag, F.coalesce(pred, F.lit(False))).drop("__all", "__mx", "__mnull", "__idx")


def split_by_budget(df: DataFrame, metric: str, id_col: str, weight: str | None, budgets,
                    group_cols: list[str] | None = None, flag: str = "__low") -> DataFrame:
    """Convenience: find cuts over a persisted key projection and flag the rows."""
    group_cols = list(group_cols or [])
    cols = group_cols + [metric, id_col] + ([weight] if weight else [])
    keys = df.select(*dict.fromkeys(cols)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cuts = find_cuts(keys, metric, id_col, weight, budgets, group_cols)
    finally:
        keys.unpersist()
    return attach_low_flag(df, metric, id_col, cuts, group_cols, flag)
