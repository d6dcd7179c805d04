"""Centroid clusters, whitening and archives against brute force."""

import base64
import hashlib
import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.llm import clustering, queries, warc, whitening

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, distance string, `a.b` int"


def brute_clusters(rows, dims, k, rounds=3, scale=64):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:k]]
    for step in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if step < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, b) in zip(kept, best) if b == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    of = lambda j: sum(d for d, b in best if b == j)
    return sorted((str(i), j, d, of(j), sum(d for d, _ in best), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, best))


def vector_rows(dims=6, n=400):
    rng = random.Random(3)
    middle = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(middle)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * dims) for i in range(n // 2)]  # a third of all rows are one vector
    rows += [(2000, [0.5] * dims)] * 3 + [(None, [0.25] * dims), (None, [0.125] * dims), (None, None), (3000, None), (3001, []), (3002, [1.0] * (dims - 1)), (3003, [1.0] * (dims + 1)), (3004, [None] + [0.0] * (dims - 1)), (3005, [NAN] * dims), (3006, [INF] + [0.0] * (dims - 1))]
    return [(i, v, 1, "x", 2) for i, v in rows]


def as_rows(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_hilbert_curve_goes_from_neighbour_to_neighbour():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = [bytes(k) for k in clustering.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(keys)
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_boxes_never_lose_the_nearest_centroid():
    rng = np.random.default_rng(0)
    dropped = 0
    for _ in range(200):
        x = rng.integers(-5, 6, (20, 3)) + rng.integers(-20, 21, 3)
        c = rng.integers(-25, 26, (12, 3))
        near = clustering.candidates(x.min(0), x.max(0), c)
        dropped += 12 - len(near)
        got = clustering.nearest(x, c[near], near)
        want = clustering.nearest(x, c, np.arange(12))
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert dropped > 1000


@pytest.mark.parametrize("k", [4, 16, 2000])
def test_clusters_equal_brute_force(spark, k):
    rows = vector_rows(n=400 if k < 100 else 20)
    got = clustering.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), dims=6, k=k)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert as_rows(got) == brute_clusters(rows, 6, k)


def test_clusters_of_large_values_and_of_nothing(spark):
    rows = [(i, [float((i * 7919 + j * 31) % 1000 - 500) * 300.0 for j in range(4)], None, None, None) for i in range(60)]
    assert as_rows(clustering.cluster(spark.createDataFrame(rows, VECTORS), dims=4, k=5)) == brute_clusters(rows, 4, 5)
    far = [(1, [3e38, -3e38], None, None, None), (2, [0.0, 0.0], None, None, None)]
    got = {r.vec_id: r.distance for r in clustering.cluster(spark.createDataFrame(far, VECTORS), dims=2, k=1, rounds=0).collect()}
    assert sorted(got.values()) == [0, 2 << 48]
    for none in ([], [(1, None, 1, "x", 1)]):
        assert clustering.cluster(spark.createDataFrame(none, VECTORS)).collect() == []


def test_no_block_or_partition_holds_a_hot_vector_alone(spark):
    rows = [(1, [0.5] * 4)] * 5000 + [(i, [i % 7 / 7.0] * 4) for i in range(5000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    blocks = clustering.hilbert_blocks(df, 4, 64, np.zeros(4, np.int64), np.full(4, 63), len(rows))
    sizes = [r.n for r in blocks.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
    assert blocks.agg(F.sum("n")).first()[0] == len(rows) and max(r.n for r in blocks.select("n").collect()) <= clustering.BLOCK
    parts = blocks.select(F.input_file_name().alias("f"), "n").groupBy("f").agg(F.sum("n").alias("n")).collect()
    assert max(r.n for r in parts) < 0.45 * len(rows) and sum(sizes) == len(rows)


def spectra():
    rng = np.random.default_rng(0)
    yield rng.standard_normal((500, 64)) * 140
    yield rng.standard_normal((300, 5)) @ rng.standard_normal((5, 40))
    yield np.repeat(np.eye(20), 30, 0) * 7.0
    yield rng.standard_normal((50, 3))
    yield rng.standard_normal((3000, 200)) * np.linspace(1, 3, 200)


def test_jacobi_davidson_reaches_double_precision():
    for x in spectra():
        x = x - x.mean(0)
        calls = []

        def product(block):
            calls.append(block.shape[1])
            return x.T @ (x @ block) / len(x)

        values, vectors = whitening.jacobi_davidson(product, x.shape[1], 8)
        exact = np.linalg.eigvalsh(x.T @ x / len(x))[::-1]
        top = exact[0]
        assert len(values) == min(8, x.shape[1]) and np.abs(values - exact[: len(values)]).max() < 1e-13 * top
        assert np.linalg.norm(product(vectors) - vectors * values, axis=0).max() <= 1.1 * max(64, x.shape[1]) * whitening.EPS * top
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
        assert len(calls) < 120


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    q = np.linalg.qr(rng.standard_normal((30, 4)))[0]
    project = lambda x: x - q @ (q.T @ x)
    rhs, shift = project(rng.standard_normal((30, 3))), np.array([0.3, -7.0, 2.0])
    t = whitening.minres(lambda x: a @ x, rhs, shift, project, 60, 1e-14)
    assert np.abs(project(a @ t - shift * t) - rhs).max() < 1e-8 and np.abs(q.T @ t).max() < 1e-10


def brute_white(rows, dims, k=8):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) + 100000 for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([v for _, v in kept], np.int64)
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [i for i, _ in kept], n, [sum((n * a - int(b)) ** 2 for a, b in zip(r.tolist(), s)) for r in x], c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


@pytest.mark.parametrize("dims", [3, 12])
def test_whitening_equals_brute_force(spark, dims):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.1 + 0.05 * j) for j in range(dims)]) for i in range(300)] + [(5, [0.5] * dims)] * 2 + [(None, [0.25] * dims), (None, None), (400, []), (401, [1.0] * (dims + 1)), (402, [None] * dims), (403, [NAN] * dims), (404, [INF] * dims)]
    rows = [(i, v, 1, "x", 2) for i, v in rows]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    ids, n, deviation, white, explained = brute_white(rows, dims)
    k = min(8, dims)
    assert len(got) == n * k and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert np.allclose(sorted({r.explained for r in got}), sorted(explained), rtol=1e-10)
    sides = []
    for c in range(k):
        own = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == c + 1)
        mine, other = (sorted((str(i), d, s * w) for i, d, w in zip(ids, deviation, white[:, c])) for s in (1, -1))
        assert [x[:2] for x in own] == [x[:2] for x in mine]
        near = lambda a, b: np.allclose([x[2] for x in a], [x[2] for x in b], rtol=1e-8, atol=1e-9)
        sides.append(near(own, mine) or near(own, other))
    assert all(sides)


def test_whitening_of_tables_without_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    for rows in ([(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(50)]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []
    line = [(i, [i / 16.0, i / 8.0, 1.0]) for i in range(64)]  # rank one
    got = whitening.whiten(spark.createDataFrame(line, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and len(got) == 64 and abs(got[0].explained - 1) < 1e-12
    huge = [(i, [1e9 * (i + 1), float(i)]) for i in range(4)]  # deviations beyond 64 bits are null
    assert {r.deviation for r in whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()} == {None}


PAGES = "page_id long, url string, html string, `a.b` int, file string"


def page_rows():
    rng = random.Random(2)
    texts = [None, "", "<p>a</p>", "<p>b</p> é日本", "x" * 70_000, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"]
    rows = [(i, f"http://h{i % 7}.example/a?b={i}", rng.choice(texts) if i % 3 else "<html>hot</html>") for i in range(150)]
    rows += [(900, "http://h/\r\nWARC-Type: x", "only"), (900, "http://h/ü", "only"), (901, None, "only"), (None, "u", "only"), (None, None, None), (902, "http://[bad", "single"), rows[5], rows[5]]
    return [(i, u, h, 1, "f") for i, u, h in rows]


def brute_captures(rows, least=0):
    raw = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    top = {}
    for i, h in raw:
        top[h] = max(top.get(h, -1), -1 if i is None else i)
    seen, out = set(), []
    for i, h in raw:
        first = len(h) < least or (top[h] == (-1 if i is None else i) and h not in seen)
        seen |= {h} if first else set()
        out.append((str(i), len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first else "revisit", None if first or top[h] < 0 else top[h]))
    return sorted(out, key=str)


def test_written_archives_give_the_pages_back(spark):
    rows = page_rows()
    for least in (0, 5):
        folder = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), least=least)
        records = warc.read_records(warc.archive_files(spark, folder))
        assert records.count() == 3 * len(rows) and records.select("record_id").distinct().count() == 3 * len(rows)
        captures = warc.assemble(records)
        got = warc.page_captures(captures)
        assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == brute_captures(rows, least)
        assert sorted(str((r.page_id, r.url)) for r in got.collect()) == sorted(str((i, u)) for i, u, *_ in rows)
        one = captures.collect()
        assert all(r.n_request == r.n_metadata == 1 and r.request.record_id != r.metadata.record_id for r in one)
        assert {bytes(r.capture.payload) for r in one if r.capture.type == "response"} == {(h or "").encode() for _, _, h, *_ in rows}
        assert all(r.capture.declared_digest == "sha1:" + r.capture.payload_digest for r in one if r.capture.type == "response")


def test_archives_of_no_pages(spark):
    folder = warc.write_archives(spark.createDataFrame([], PAGES))
    captures = warc.assemble(warc.read_records(warc.archive_files(spark, folder)))
    assert captures.collect() == [] and warc.page_captures(captures).collect() == []


def foreign(kind, name, to=(), block=b"", more=()):
    return warc.record_bytes([("WARC-Type", kind), ("WARC-Record-ID", name), *[("WARC-Concurrent-To", t) for t in to], *more], block)


def test_records_of_other_writers(spark, tmp_path):
    answer = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nbody"
    http = [("Content-Type", "application/http; msgtype=response")]
    rows = [
        foreign("warcinfo", "<i>"),
        foreign("response", "<r1>", (), answer, http), foreign("request", "<q1>", ["<r1>"]), foreign("metadata", "<m1>", ["<q1>"], b"via: x"),  # through the request
        foreign("request", "<q2>"), foreign("response", "<r2>", ["<q2>", "<m2>"], answer, http), foreign("metadata", "<m2>"),  # the response names them
        foreign("resource", "<r3>", (), b"plain"), foreign("metadata", "<m4>", ["<nowhere>"]),
        *[foreign("metadata", f"<n{k}>", ["<r3>"]) for k in range(5)],
        b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <r4>\r\nX: a\r\n b\r\ncontent-length: 2\r\n\r\nhi\r\n\r\n",
        foreign("response", "<cut>", (), b"x" * 100)[:-60],
    ]
    path = tmp_path / "a.warc"
    path.write_bytes(b"".join(rows))
    broken = tmp_path / "b.warc.gz"
    broken.write_bytes(warc._member(foreign("response", "<r5>", (), b"ok")) + warc._member(foreign("response", "<r6>"))[:20])
    (tmp_path / "c.warc").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a.warc", "b.warc.gz", "c.warc")], "file string")
    got = {r.capture.record_id: r for r in warc.assemble(warc.read_records(files)).collect()}
    assert set(got) == {"<r1>", "<r2>", "<r3>", "<r4>", "<r5>"}
    names = {k: (r.request and r.request.record_id, r.metadata and r.metadata.record_id, r.n_request, r.n_metadata) for k, r in got.items()}
    assert names["<r1>"] == ("<q1>", "<m1>", 1, 1) and names["<r2>"] == ("<q2>", "<m2>", 1, 1) and names["<r3>"] == (None, "<n0>", 0, 5) and names["<r4>"][2:] == (0, 0)
    assert bytes(got["<r1>"].capture.payload) == b"body\r\n\r\nbody" and got["<r1>"].metadata.head == "via: x" and got["<r3>"].capture.payload_bytes == 5
    assert [f["x"] for f, _ in warc.parse_records(io.BytesIO(rows[-2]))] == [["a b"]]


def test_queries_of_these_operators_read_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    assert as_rows(queries.op11_centroid_clusters(spark, sf)) == brute_clusters([(r.vec_id, r.embedding) for r in rows], 64, 16)
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = queries.op12_warc_captures(spark, sf).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute_captures(pages)
