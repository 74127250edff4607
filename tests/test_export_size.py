"""Size of the formula-safe CSV export."""

import os

from batchlens.sources import export


def test_export_is_compressed_and_read_back(spark, tmp_path):
    """A report repeats its texts for every batch; what is written is a small part of that, and all cells come back."""
    text = "Reduce heat duration by a few minutes to cut excess energy, then compare the batch with the golden profile."
    cells = [text, "=1+1", "", None, 'a "quoted", cell', "+2", "@x", "\tz"]
    rows = [(f"B{k:09d}", k, cells[k % len(cells)]) for k in range(4000)]
    df = spark.createDataFrame(rows, "Batch_ID string, Row_No bigint, Value string").repartition(3)
    path = str(tmp_path / "csv")
    export.write_csv(df, path)
    size = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.startswith("part-"))
    assert size < sum(len(a) + len(str(b)) + len(c or "") for a, b, c in rows) / 3
    back = export.read_csv(spark, path, "Batch_ID string, Row_No bigint, Value string").orderBy("Row_No").collect()
    want = ["'" + c if c and c[0] in "=+-@\t" else c for c in cells]
    assert [tuple(r) for r in back] == [(a, b, want[b % len(want)]) for a, b, _c in rows]
