from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from salespark.sources import flatfile, loads
from salespark.streaming.ingest import start_flat_file_load


def test_incremental_flat_file_load(spark, sample_df):
    base = tempfile.mkdtemp(prefix="salespark-stream-")
    src, tables, ckpt = f"{base}/in", f"{base}/tables", f"{base}/ckpt"
    os.makedirs(src)
    flat = flatfile.to_flat(sample_df)
    # first drop: April orders
    flatfile.write_flat_csv(flat.where(F.month("Order_Date") == 4).coalesce(1), f"{base}/jan")
    for name in os.listdir(f"{base}/jan"):
        if name.endswith(".csv"):
            shutil.copyfile(f"{base}/jan/{name}", f"{src}/jan.csv")
    q = start_flat_file_load(spark, src, tables, checkpoint_location=ckpt)
    q.awaitTermination(120)
    c, p, o = flatfile.read_tables(spark, tables)
    assert (o.count(), c.count(), p.count()) == (4, 3, 3)

    # second drop: the other months; known customers and products stay once
    flatfile.write_flat_csv(flat.where(F.month("Order_Date") > 4).coalesce(1), f"{base}/all")
    for name in os.listdir(f"{base}/all"):
        if name.endswith(".csv"):
            shutil.copyfile(f"{base}/all/{name}", f"{src}/all.csv")
    q = start_flat_file_load(spark, src, tables, checkpoint_location=ckpt)
    q.awaitTermination(120)
    c, p, o = flatfile.read_tables(spark, tables)
    assert (o.count(), c.count(), p.count()) == (12, 5, 3)
    assert o.select("order_id").distinct().count() == 12


def test_continuous_trigger_load(spark, sample_df):
    base = tempfile.mkdtemp(prefix="salespark-stream-")
    src, tables = f"{base}/in", f"{base}/tables"
    os.makedirs(src)
    flatfile.write_flat_csv(flatfile.to_flat(sample_df).coalesce(1), f"{base}/all")
    for name in os.listdir(f"{base}/all"):
        if name.endswith(".csv"):
            shutil.copyfile(f"{base}/all/{name}", f"{src}/all.csv")
    q = start_flat_file_load(spark, src, tables, checkpoint_location=f"{base}/ckpt",
                             available_now=False, processing_time="1 second",
                             max_files_per_trigger=1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    c, p, o = flatfile.read_tables(spark, tables)
    assert (o.count(), c.count(), p.count()) == (12, 5, 3)


def test_batch_size_does_not_change_the_rows(spark):
    """6,000 lines in seven files, one file or all of them a batch; a replayed batch adds nothing."""
    from salespark.sources.tables import sales_fact
    from salespark.streaming.ingest import load_batch
    base = tempfile.mkdtemp(prefix="salespark-stream-")
    flat = flatfile.to_flat(sales_fact(spark, "/root/testdata/sf0.001"))
    for c in [f.name for f in flat.schema if f.dataType.simpleString() == "bigint"]:
        flat = flat.withColumn(c, F.col(c).cast("string"))
    flatfile.write_flat_csv(flat.repartition(7), f"{base}/in")
    for per_batch in (None, 1):
        tables = f"{base}/tables-{per_batch}"
        start_flat_file_load(spark, f"{base}/in", tables, checkpoint_location=f"{base}/ckpt-{per_batch}",
                             max_files_per_trigger=per_batch).awaitTermination(200)
        assert flatfile.read_tables(spark, tables)[2].count() == 6000
        name = loads.commits(spark, tables)[0].load_id
        batch = flatfile.read_flat_csv(spark, f"{base}/in")
        if per_batch is None:
            load_batch(batch, tables, name)
            assert flatfile.read_tables(spark, tables)[2].count() == 6000
