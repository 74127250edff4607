"""Time handling and sessionisation of machine streams.

Every order-dependent step takes explicit, unique order columns and runs on
``ordering.ordered_scan`` (range-partitioned, skew-safe), never on an
unpartitioned window or a per-machine window that would put a hot machine
into a single task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.constants import ACTIVE_MODES
from batchlens.operators.ordering import ordered_index, ordered_scan
from batchlens.operators.stats import pct, stats_row

SYNTHETIC_START = "2024-01-01 00:00:00"


def epoch_micros(ts: str | Column) -> Column:
    """Wall-clock microseconds since 1970-01-01 (time-zone independent)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def parse_timestamp(c: Column) -> Column:
    """Lenient parse to TIMESTAMP_NTZ (wall clock, UTC semantics); bad -> NULL."""
    return F.coalesce(c.try_cast("timestamp_ntz"), F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz"))


def active_flag(mode: Column) -> Column:
    """Case-insensitive membership in the active-mode list; NULL -> inactive."""
    return F.coalesce(F.lower(mode).isin(*ACTIVE_MODES), F.lit(False))


def zfill4(n: Column) -> Column:
    s = n.cast("string")
    return F.when(F.length(s) < 4, F.lpad(s, 4, "0")).otherwise(s)


def machine_token(machine: Column) -> Column:
    """Short token of a machine id. Where stripping, upper case or the cut at 12
    characters loses anything, a hash of the whole id follows, so two machines
    never share a batch id."""
    short = F.substring(F.upper(F.regexp_replace(machine, "[^A-Za-z0-9]+", "")), 1, 12)
    return F.when(short == machine, short).otherwise(F.concat(short, F.lit("-"), F.substring(F.sha2(machine, 256), 1, 16)))


def clean_machine(machine: Column) -> Column:
    return F.coalesce(F.nullif(machine.cast("string"), F.lit("")), F.lit("M01"))


# --------------------------------------------------------------------- B8, B9
def repair_timestamps(df: DataFrame, ts_col: str | None, order_col: str, out: str = "Timestamp") -> DataFrame:
    """Parse; when absent or entirely unparsable use 2024-01-01 + n minutes
    (n = row position by ``order_col``); otherwise forward-fill then
    back-fill in row order, and any remaining gap gets the synthetic value."""
    if ts_col is None:
        idx = ordered_index(df, [order_col], "__n")
        return idx.withColumn(out, F.lit(SYNTHETIC_START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("__n"))).drop("__n")
    d = df.withColumn("__ts", parse_timestamp(F.col(ts_col)))
    counts = stats_row(d, [F.count("__ts").alias("n"), F.count_if(F.col("__ts").isNull()).alias("m")])
    if counts["n"] == 0:
        d = ordered_index(d.drop("__ts"), [order_col], "__n")
        return d.withColumn(out, F.lit(SYNTHETIC_START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("__n"))).drop("__n")
    if counts["m"] == 0:
        return d.withColumn(out, F.col("__ts")).drop("__ts")
    fwd = ordered_scan(d, [], [F.col(order_col)], ffills={"__fwd": F.col("__ts")}, pos_col="__pos")
    both = ordered_scan(fwd, [], [F.col(order_col).desc()], ffills={"__bwd": F.col("__fwd")}, pos_col="__rpos")
    synth = F.lit(SYNTHETIC_START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("__pos") - F.lit(1))
    return both.withColumn(out, F.coalesce(F.col("__bwd"), synth)).drop("__ts", "__fwd", "__bwd", "__pos", "__rpos")


def step_minutes(df: DataFrame, ts_col: str = "Timestamp", order_tiebreak: str | None = None) -> float:
    """Median of the global sorted timestamp differences in (0, 120)
    minutes, clipped to [0.2, 15]; 1.0 when there is none."""
    order = [F.col(ts_col)] + ([F.col(order_tiebreak)] if order_tiebreak else [])
    scanned = ordered_scan(df.select(ts_col, *( [order_tiebreak] if order_tiebreak else [])), [], order,
                           lags={"prev_us": epoch_micros(ts_col)}, pos_col="__p")
    diff = (epoch_micros(ts_col) - F.col("prev_us")) / F.lit(60_000_000.0)
    st = stats_row(scanned.withColumn("d", diff).filter((F.col("d") > 0) & (F.col("d") < 120)), [pct("d", 0.5).alias("m")])
    if st["m"] is None:
        return 1.0
    return float(min(15.0, max(0.2, st["m"])))


def step_frame(df: DataFrame, ts_col: str = "Timestamp", order_tiebreak: str | None = None) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(step_minutes(df, ts_col, order_tiebreak),)], "step_minutes double")


# ------------------------------------------------------------------- W2, W3
@dataclass
class SessionResult:
    frame: DataFrame
    gap_threshold: float
    sparse: bool


def virtual_batches(
    df: DataFrame,
    ts_col: str = "Timestamp",
    machine_col: str | None = "machine_id",
    mode_col: str | None = "operation_mode",
    order_col: str = "row_order",
    sparse: str = "never",
    out: str = "Auto_Batch_ID",
) -> SessionResult:
    """Per machine, ordered by (timestamp, row order), a new batch starts
    on a gap above clip(3 x global median positive gap, 30, 720) minutes or on
    an inactive->active edge (the first active row counts as an edge, so ids
    start at 0002 unless the machine starts inactive). Ids are
    ``AUTO_<token>_<nnnn>``. ``sparse``: 'never' (gaps and edges make the
    batches, whatever the size of the table), 'always' (60-row windows), or, on
    request only, 'auto': windows if distinct ids exceed max(1000, 20 % of rows)."""
    machine = clean_machine(F.col(machine_col)) if machine_col else F.lit("M01")
    mode = F.col(mode_col).cast("string") if mode_col else F.lit("Run")
    any_active = stats_row(df, [F.count_if(active_flag(mode)).alias("a")])["a"] > 0
    active = active_flag(mode) if any_active else F.lit(True)
    d = df.withColumns({"__machine": machine, "__active": active})
    order = [F.col(ts_col), F.col(order_col)]
    s1 = ordered_scan(
        d, ["__machine"], order,
        lags={"__prev_us": epoch_micros(ts_col), "__prev_active": F.col("__active")},
        pos_col="__mpos", layout_col="__layout",
    )
    gap = F.coalesce((epoch_micros(ts_col) - F.col("__prev_us")) / F.lit(60_000_000.0), F.lit(0.0))
    s1 = s1.withColumns(
        {
            "__gap": gap,
            "__mode_start": F.col("__active") & ~F.coalesce(F.col("__prev_active"), F.lit(False)),
        }
    )
    typical = stats_row(s1.filter(F.col("__gap") > 0), [pct("__gap", 0.5).alias("m")])["m"]
    typical = 30.0 if typical is None else float(typical)
    threshold = float(min(720.0, max(30.0, typical * 3.0)))
    new_batch = (F.col("__gap") > F.lit(threshold)) | F.col("__mode_start")
    # the second scan shuffles and writes what it is given: of the first one's columns only those still needed
    spent = ["__prev_us", "__prev_active", "__active", "__gap", "__mode_start", *["__mpos"] * (sparse == "never")]
    s1 = s1.withColumn("__new", new_batch).drop(*spent)
    # same keys and order as the first scan: reuse its layout, no second range shuffle
    s2 = ordered_scan(s1, ["__machine"], order, sums={"__nb": F.col("__new").cast("int")}, pos_col="__mpos2", presorted="__layout")
    token = machine_token(F.col("__machine"))
    gap_id = F.concat(F.lit("AUTO_"), token, F.lit("_"), zfill4((F.col("__nb") + F.lit(1)).cast("bigint")))
    s2 = s2.withColumn("__gap_id", gap_id)
    if sparse == "always":
        use_sparse = True
    elif sparse == "never":
        use_sparse = False
    else:
        st = stats_row(s2, [F.countDistinct("__gap_id").alias("d"), F.count(F.lit(1)).alias("n")])
        use_sparse = st["d"] > max(1000, int(st["n"] * 0.20))
    if use_sparse:
        window = zfill4(F.floor((F.col("__mpos") - F.lit(1)) / F.lit(60)) + F.lit(1))
    res = s2.withColumn(out, F.concat(F.lit("AUTO_"), token, F.lit("_"), window) if use_sparse else F.col("__gap_id"))
    res = res.drop(*[c for c in res.columns if c.startswith("__")])
    return SessionResult(res, threshold, use_sparse)


# ----------------------------------------------------------------------- W4, W5
def fill_batch_ids(df: DataFrame, batch_col: str, auto_col: str = "Auto_Batch_ID", out: str = "Batch_ID") -> DataFrame:
    """Keep provided ids; blank/NULL/'nan' ones take the virtual id."""
    b = F.col(batch_col).cast("string")
    missing = b.isNull() | (b == F.lit("")) | (b == F.lit("nan"))
    return df.withColumn(out, F.when(missing, F.col(auto_col)).otherwise(b))


def elapsed_minutes(
    df: DataFrame, batch_col: str = "Batch_ID", ts_col: str = "Timestamp", order_col: str = "row_order",
    process_time_col: str | None = None, out: str = "Time_Minutes",
) -> DataFrame:
    """Minutes since the batch's first timestamp. If that is <= 0 (or NULL)
    everywhere: position within the batch (row order) - 1; if still <= 0 and a
    process-time column has values: that column forward-filled, NULL -> 0."""
    # the largest value needs no join: a batch's last time is as far from its first one as any
    spans = df.filter(F.col(batch_col).isNotNull()).groupBy(batch_col).agg(F.min(ts_col).alias("__start"), F.max(ts_col).alias("__end"))
    minutes = lambda end: F.timestamp_diff("MICROSECOND", F.col("__start"), F.col(end)) / F.lit(60_000_000.0)
    mx = stats_row(spans, [F.max(minutes("__end")).alias("m")])["m"]
    d = df.join(spans.drop("__end"), on=batch_col, how="left").withColumn(out, minutes(ts_col)).drop("__start")
    if mx is None or mx <= 0.0:
        d = ordered_scan(d.drop(out), [batch_col], [F.col(order_col)], pos_col="__bpos")
        d = d.withColumn(out, (F.col("__bpos") - F.lit(1)).cast("double")).drop("__bpos")
        mx = stats_row(d, [F.max(out).alias("m")])["m"]
        if process_time_col is not None and (mx is None or mx <= 0.0):
            has_pt = stats_row(d, [F.count(process_time_col).alias("n")])["n"] > 0
            if has_pt:
                d = ordered_scan(d.drop(out), [], [F.col(order_col)], ffills={"__pt": F.col(process_time_col).cast("double")}, pos_col="__gpos")
                d = d.withColumn(out, F.coalesce(F.col("__pt"), F.lit(0.0))).drop("__pt", "__gpos")
    return d.withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def utc_instant(ntz: str | Column) -> Column:
    """TIMESTAMP_NTZ wall clock -> the TIMESTAMP instant with that wall clock in
    UTC (independent of the session time zone; event time for watermarks)."""
    return F.timestamp_micros(epoch_micros(ntz))


def utc_wall_clock(ts: str | Column) -> Column:
    """TIMESTAMP instant -> its UTC wall clock as TIMESTAMP_NTZ."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
