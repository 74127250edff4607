"""Staging and scans: what one task reads stays bounded, feeds carry what is read from them."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from batchlens.plans import q_compare, q_feeds, q_stream, registry
from batchlens.streaming import feeds
from batchlens.streaming import streams as ST
from conftest import SF_SMALL


def test_a_key_chunk_is_read_by_several_tasks(spark, monkeypatch):
    from batchlens.operators import stats

    seen = []
    keep = stats.materialize
    monkeypatch.setattr(stats, "materialize", lambda df: seen.append(df.rdd.getNumPartitions()) or keep(df))
    path = tempfile.mkdtemp(prefix="bl-stage-")
    df = spark.range(2000).select(F.format_string("B%05d", "id").alias("k"), "id")
    fpc = ST.stage_key_chunks(df, "k", path, 4, 2)
    assert fpc == 2 and seen[0] >= 8
    files = sorted(glob.glob(os.path.join(path, "*.parquet")), key=lambda f: os.stat(f).st_mtime_ns)
    assert len(files) == 8
    spans = []
    for k in range(4):
        r = spark.read.parquet(*files[2 * k:2 * k + 2]).agg(F.min("k"), F.max("k"), F.count("k")).first()
        spans.append(tuple(r))
    assert sum(n for _a, _z, n in spans) == 2000
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_feeds_are_staged_with_the_columns_they_need(spark, monkeypatch):
    registry.load_all()
    staged = []
    order, chunks = feeds.stage_in_order, ST.stage_key_chunks
    monkeypatch.setattr(feeds, "stage_in_order", lambda df, *a: staged.append(df.columns) or order(df, *a))
    monkeypatch.setattr(ST, "stage_key_chunks", lambda df, *a: staged.append(df.columns) or chunks(df, *a))
    q_feeds.q_stream_red_alerts(spark, SF_SMALL)
    q_stream.q_stream_deviation(spark, SF_SMALL)
    assert max(map(len, staged)) <= 15


def test_previous_batch_scan_has_ranges_of_bounded_size(spark, monkeypatch):
    registry.load_all()
    want = sorted(map(tuple, q_compare.q_flex_compare(spark, SF_SMALL).collect()))
    parts = []
    scan = q_compare.ordered_scan
    monkeypatch.setattr(q_compare, "ordered_scan", lambda *a, **k: parts.append(k.get("partitions")) or scan(*a, **k))
    monkeypatch.setattr(q_compare, "RANGE_ROWS", 100, raising=False)
    assert sorted(map(tuple, q_compare.q_flex_compare(spark, SF_SMALL).collect())) == want
    assert parts[0] == 15  # 1,500 batches
