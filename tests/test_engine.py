import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumengrid.functions import color, filters, scalar
from lumengrid.operators import regions
from lumengrid.operators.runtime import map_images, pixels
from lumengrid.plans import catalog
from lumengrid.sources import images as src
from lumengrid.streaming import images as stream

DATA = "/root/testdata/sf0.001"


def test_map_images_handles_shapes_nulls_and_empties(spark):
    rows = [(1, [2, 2], [1.0, 2.0, 3.0, 4.0]), (2, [3], [1.0, 5.0, 3.0]), (3, None, None), (4, [2, 2], [1.0]), (5, [1, 1], [7.0])]
    df = spark.createDataFrame(rows, "image_id long, shape array<int>, img array<double>")
    got = {r.image_id: r.img for r in map_images(df, lambda x: filters.maximum_filter(x)).collect()}
    assert got == {1: [4.0] * 4, 2: [5.0, 5.0, 5.0], 3: None, 4: None, 5: [7.0]}
    assert map_images(df.limit(0), filters.maximum_filter).count() == 0
    mixed = [(k, [1 + k % 3, 2], [float(k + j) for j in range(2 + 2 * (k % 3))]) for k in range(20)]
    df = spark.createDataFrame(mixed, df.schema).coalesce(1)
    assert {r.image_id: r.img for r in map_images(df, lambda x: x + 1).collect()} == {k: [v + 1 for v in img] for k, _, img in mixed}


def test_flagship_counts_every_labelled_pixel(spark):
    out = entry.entry(spark).toPandas()
    assert len(out) and (out.area > 0).all() and (out.bbox_2 > out.bbox_0).all()


def test_region_table_known_square(spark):
    px = spark.createDataFrame([(1, y, x, 1, float(y)) for y in range(2, 4) for x in range(5, 9)], "image_id long, y int, x int, label int, v double")
    r = regions.region_table(px).first()
    assert (r.area, r.bbox_0, r.bbox_1, r.bbox_2, r.bbox_3) == (8, 2, 5, 4, 9)
    assert r.centroid_0 == 2.5 and r.centroid_1 == 6.5 and abs(r.extent - 1) < 1e-12 and abs(r.orientation - np.pi / 2) < 1e-9 or abs(r.orientation + np.pi / 2) < 1e-9


def test_colours(spark):
    mid, stains = (0.2, 0.5, 0.9), (0.05, 0.02, 0.03)
    for there, back in ((color.rgb2hsv, color.hsv2rgb), (color.rgb2lab, color.lab2rgb), (color.rgb2luv, color.luv2rgb), (color.rgb2yuv, color.yuv2rgb), (color.rgb2xyz, color.xyz2rgb), (color.hed2rgb, color.rgb2hed)):
        start = stains if there is color.hed2rgb else mid
        got = spark.range(1).select(color.triple(*start).alias("c")).select(back(there(F.col("c"))).alias("d")).first().d
        assert np.allclose(tuple(got), start, atol=1e-3)
    # Two pairs of the published CIEDE2000 test set.
    pairs = [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 2.5, 0), (73, 25, -18), 27.1492)]
    for p, q, want in pairs:
        got = spark.range(1).select(color.deltaE_ciede2000(color.triple(*map(float, p)), color.triple(*map(float, q))).alias("d")).first().d
        assert abs(got - want) < 1e-4


def test_scalars(spark):
    df = spark.createDataFrame([(0.0, 0.5), (0.25, 1.0), (-1.0, 1.0)], "a double, b double")
    got = [tuple(r) for r in df.select(scalar.entr(F.col("a")), scalar.kl_div(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (0.0, 0.5) and got[2] == (float("-inf"), float("inf"))
    for mode in filters.MODES:
        n = 5
        i = spark.range(-7, 12).select(scalar.boundary(F.col("id"), n, mode).alias("m")).toPandas().m.to_numpy()
        assert (i == filters.boundary_index(n, 7, 7, mode)).all()


@pytest.mark.parametrize("name", ["uniform_filter", "median_filter", "label", "threshold_otsu", "integral_image", "rgb2hsv"])
def test_query_equals_its_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    order = sorted(got.columns)
    a, b = (d[order].sort_values(order).to_numpy(float) for d in (got, want))
    assert a.shape == b.shape and np.allclose(a, b, atol=2e-6)


def test_plans_push_down(spark):
    plan = catalog.QUERIES["labelled_histogram"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan and "PushedFilters: [" in plan and "partial_count" in plan


def test_streams(spark, tmp_path):
    src.write_images(src.embedding_images(spark, DATA), f"file://{tmp_path}/in")
    batch = src.read_images(spark, f"file://{tmp_path}/in")
    arriving = stream.stream_images(spark, f"file://{tmp_path}/in", batch.schema)
    q = stream.write(stream.filtered(arriving, filters.uniform_filter), f"file://{tmp_path}/out", f"file://{tmp_path}/chk")
    q.awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == batch.count()
    h = stream.running_histogram(arriving, 4, -1, 1).writeStream.format("memory").queryName("h").outputMode("complete").trigger(availableNow=True).start()
    h.awaitTermination(60)
    assert spark.table("h").agg(F.sum("n")).first()[0] == batch.count() * 64


def test_pixels_view(spark):
    df = spark.createDataFrame([(1, [1, 2], [0.5, 0.25])], "image_id long, shape array<int>, img array<double>")
    assert [tuple(r) for r in pixels(df).collect()] == [(1, 0, 0, 0.5), (1, 0, 1, 0.25)]


def test_images_of_too_few_levels_have_no_thresholds(spark, tmp_path):
    rows = [(0, [0.5] * 64, 1), (1, [-0.5, 0.5] * 32, 1), (2, [-0.5, -0.5, 0.0, 0.5] * 16, 1), (3, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["threshold_multiotsu"](spark, str(tmp_path)).collect()
    assert sorted((r.image_id, r.x, r.v) for r in got) == [(2, 0, 63.0), (2, 1, 127.0)]
