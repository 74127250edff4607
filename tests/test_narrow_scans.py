"""The scans behind virtual batches get only the columns that are needed after them."""

import datetime as dt

from batchlens.operators import sessions
from batchlens.plans.adaptive import SIGNALS, prepare_rows


def sensor_rows(spark, machine="M1"):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=k * (200 if k == 3 else 1)), machine, "Running" if k % 4 else "Idle", float(k), 0.01) for k in range(8)]
    return spark.createDataFrame(rows, "row_order long, timestamp timestamp_ntz, machine_id string, operation_mode string, power_kw double, defect_rate double")


def test_scans_move_no_absent_signal_and_no_source_column(spark, monkeypatch):
    seen, scan = [], sessions.ordered_scan

    def spy(df, *args, **more):
        seen.append(set(df.columns))
        return scan(df, *args, **more)

    monkeypatch.setattr(sessions, "ordered_scan", spy)
    rows, _, generated, _ = prepare_rows(sensor_rows(spark), "row_order")
    needed = {"row_order", "Timestamp", "Machine_ID", "Phase", "sig_power_kw", "sig_defect_rate", "__machine"}
    assert seen == [needed | {"__active"}, needed | {"__new", "__layout"}]
    assert generated and rows.columns == ["row_order", "Timestamp", "Batch_ID", "Machine_ID", "Phase", *[f"sig_{s}" for s in SIGNALS]]
    got = rows.orderBy("row_order").collect()
    assert [r.sig_power_kw for r in got] == [float(k) for k in range(8)] and all(r.sig_pressure_bar is None for r in got)
    assert [r.Batch_ID[-4:] for r in got] == ["0001", "0002", "0002", "0004", "0002", "0003", "0003", "0003"]  # row 3 is the last one, after a gap


def test_given_batch_ids_are_kept_and_gaps_filled(spark):
    df = sensor_rows(spark).selectExpr("*", "CASE WHEN row_order < 4 THEN 'L1' WHEN row_order = 4 THEN '' END AS batch_id")
    got = [r.Batch_ID for r in prepare_rows(df, "row_order")[0].orderBy("row_order").collect()]
    assert got[:4] == ["L1"] * 4 and all(b.startswith("AUTO_M1_") for b in got[4:])
