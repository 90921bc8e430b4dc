"""Paths B and C end to end with real forests."""

import os

import pandas as pd
from pyspark.sql import functions as F

from hourcast.config import ALL_FEATURES, OPERATIONS
from hourcast.plans import catalog, quoting
from hourcast.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_quotes_to_sales_view(spark):
    models = catalog.models_for(spark, SF)
    records = catalog._records(spark, SF)
    # quoted hours for some of the accepted quotes
    accepted = [r.quote_id for r in catalog.QUERIES["quote_records"](spark, SF).select("quote_id").orderBy("quote_id").collect()]
    assert accepted
    quoted = spark.createDataFrame([(accepted[0], "ME", 12.0), (accepted[0], "EE", 3.5)], "quote_id long, bucket string, quoted_hours double")
    view = {k: df.collect() for k, df in quoting.predict_quotes(spark, records, models, quoted).items()}
    n = len(accepted)
    assert len(view["operations"]) == 12 * n and len(view["buckets"]) == 9 * n and len(view["totals"]) == n
    assert len(view["summary"]) == 9 * n + 1 and len(view["chart"]) == 18
    totals = {r.quote_id: r.total_p50 for r in view["totals"]}
    for q, total in totals.items():
        assert abs(sum(r.p50 for r in view["buckets"] if r.quote_id == q) - total) < 1e-6
        assert abs(sum(r.p50 for r in view["operations"] if r.quote_id == q) - total) < 1e-6
    first = next(r for r in view["status"] if r.quote_id == accepted[0])
    assert first.quoted_total == 15.5 and first.project_status
    rejected = {r.quote_id for r in view["rejected"]}
    assert not rejected & set(accepted) and len(rejected) + n == records.count()


def test_batch_file(spark, tmp_dir):
    models = catalog.models_for(spark, SF)
    src, out = os.path.join(tmp_dir, "quotes.csv"), os.path.join(tmp_dir, "out")
    # no id column: scoring needs none
    quotes = catalog.quote_batch(spark, SF).select([F.col(c).cast("string") for c in ALL_FEATURES if c in catalog.quote_batch(spark, SF).columns])
    pdf = quotes.toPandas()
    for c in ALL_FEATURES:
        if c not in pdf:
            pdf[c] = None
    pdf.to_csv(src, index=False)
    quoting.predict_batch_file(spark, src, models, out)
    got = pd.concat(pd.read_csv(os.path.join(out, f)) for f in os.listdir(out) if f.endswith(".csv"))
    assert len(got) == len(pdf) and {f"{op}_p50" for op in OPERATIONS} <= set(got.columns)
    assert ((got["me10_p10"] <= got["me10_p90"]) & (got["me10_std"] >= 0)).all()
    sums = got[[f"{op}_p50" for op in OPERATIONS]].sum(axis=1)
    assert (abs(sums - got["total_p50"]) < 1e-6).all()


def test_fixture_quotes_exist(spark):
    assert fixtures.quoted_hours(spark, SF).count() > 0
