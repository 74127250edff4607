"""Wide projections run in methods that the JVM compiles."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from batchlens import session
from batchlens.plans import registry
from batchlens.plans.adaptive import scrub


def _fused(df) -> bool:
    return df._jdf.queryExecution().executedPlan().execute().scope().get().name().startswith("WholeStageCodegen")


def test_a_query_bounds_fused_methods(spark, tmp_path, monkeypatch):
    """Sixty cleaned columns in one fused method are too long for the JVM's compiler; the query's own session
    settings keep them out of it, and the values stay."""
    key, limit = session.METHOD_LIMIT
    at = str(tmp_path / "wide")
    spark.range(50).select("id", *[F.when(F.col("id") % (k + 2) > 0, F.col("id") * 0.5 + k).alias(f"c{k}") for k in range(60)]).write.parquet(at)
    monkeypatch.setitem(registry.QUERIES, "wide_scrub", lambda spark, sf: scrub(spark.read.parquet(at)))
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "65535")
        out = entry.queries()["wide_scrub"](spark, "")
        assert spark.conf.get(key) == "65535" and _fused(out)  # a limit of the session's own is left alone
        want = sorted(map(tuple, out.collect()))
        spark.conf.unset(key)
        out = entry.queries()["wide_scrub"](spark, "")
        assert spark.conf.get(key) == limit and not _fused(out)
        assert sorted(map(tuple, out.collect())) == want
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
