from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from vectide.functions import metrics, quality, quantize, strings
from vectide.functions.sql import register
from vectide.operators import ann, cluster, join, knn
from vectide.operators.table import Config, VectorTable
from vectide.plans.evaluation import Dataset, evaluate
from vectide.plans.registry import ORACLES, QUERIES
from vectide.sources.folder import written
from vectide.sources.memory import from_arrays, padded
from vectide.sources.matrix import load_matrix, random_vectors, save_matrix
from vectide.streaming.upsert import latest, upserts, within

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(*v):
    return F.array(*[F.lit(float(x)) for x in v])


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert same(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()) == ""


def test_metric_corner_cases(spark):
    m = metrics.METRICS
    assert one(spark, m["cos"](vec(0, 0), vec(0, 0))) == 0
    assert one(spark, m["cos"](vec(0, 0), vec(1, 0))) == 1
    assert one(spark, m["cos_i8"](vec(1, 0), vec(0, 1))) == 0
    assert one(spark, m["pearson"](vec(1, 1), vec(2, 3))) == 0
    assert one(spark, m["l2sq"](vec(1, 2), vec(3, 5))) == 13
    assert math.isnan(one(spark, m["tanimoto"](F.array(F.lit(0).cast("long")), F.array(F.lit(0).cast("long")))))
    assert math.isnan(one(spark, m["sorensen"](F.array(F.lit(0).cast("long")), F.array(F.lit(0).cast("long")))))
    assert one(spark, m["haversine"](vec(0, 0), vec(0, 180))) == pytest.approx(math.pi)
    assert one(spark, m["ip"](F.lit(None).cast("array<double>"), vec(1))) is None
    assert one(spark, m["divergence"](vec(0.5, 0.5), vec(0.5, 0.5))) == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        metrics.metric("nothing")


def test_golden_strings(spark):
    rows = spark.createDataFrame([(42, "école"), (43, "école")], "id int, w string")
    ref = F.lit("écolé")
    f = [strings.levenshtein_bytes, strings.levenshtein_unicode, strings.hamming_bytes, strings.hamming_unicode]
    got = rows.orderBy("id").select(*[g(F.col("w"), ref) for g in f], *[g(F.col("w"), ref, 2) for g in f]).collect()
    assert [tuple(r) for r in got] == [(5, 3, 7, 6, 2, 2, 2, 2), (2, 1, 2, 1, 2, 1, 2, 1)]
    assert one(spark, strings.hamming_unicode(F.lit(""), F.lit("ab"))) == 2
    assert one(spark, strings.hamming_unicode(F.lit(""), F.lit(""))) == 0


def test_sql_functions(spark):
    assert len(register(spark)) == 23
    q = "SELECT distance_hamming_binary(X'FFFFFF', X'FFFF00') h, distance_jaccard_binary(X'FFFFFF', X'FFFF00') j, distance_cosine_f32('[4.0, 5.0, 6.0]', '7, 8, 9') c, distance_sqeuclidean_f64(1D, cast(null as double), 3D, 2D) s"
    r = spark.sql(q).first()
    assert (r.h, r.j, r.s) == (8, pytest.approx(1 / 3), 8)
    assert r.c < 0.002


def test_quantize(spark):
    assert one(spark, quantize.to_i8(vec(0, 0))) == [0, 0]
    assert one(spark, quantize.to_i8(vec(3, -4))) == [76, -101]
    assert one(spark, quantize.to_bits(vec(1, 0, 1))) == [5 << 61 if 5 << 61 < 1 << 63 else (5 << 61) - (1 << 64)]
    rows = spark.createDataFrame([([1.0001, -2.5],), (None,)], "v array<float>")
    f16, bf16 = rows.select(quantize.to_f16("v"), quantize.to_bf16("v")).first()
    assert f16 == [float(np.float16(1.0001)), -2.5] and bf16 == [1.0, -2.5]


def test_search_forms_agree_and_ties_go_by_key(spark):
    x = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(12)] + [(99, None)], "key long, vector array<double>")
    q = x.filter("key < 2").select(F.col("key").alias("query_id"), "vector")
    for kind in ("ip", "cos", "l2sq"):
        a, b = (sorted(map(tuple, knn.search(q, x, 5, kind, native=n).select("query_id", "rank", "key").collect())) for n in (False, True))
        assert a == b
    got = knn.search(q, x, 4, "l2sq", block=1).filter("query_id = 0").orderBy("rank").collect()
    assert [r.key for r in got] == [0, 3, 6, 9]
    assert knn.search(q, x, 100).count() == 24
    assert knn.search(q.limit(0), x, 3).count() == 0


def test_sets_and_strings_as_objects(spark):
    x = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 4]), (3, [9])], "key long, vector array<int>")
    q = x.filter("key = 1").select(F.col("key").alias("query_id"), "vector")
    assert [r.key for r in knn.search(q, x, 2, "jaccard").orderBy("rank").collect()] == [1, 2]


def test_table_changes(spark):
    t = VectorTable.empty(spark, Config(2)).add(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "key long, vector array<double>"))
    with pytest.raises(ValueError):
        t.add(spark.createDataFrame([(1, [0.0, 0.0])], "key long, vector array<double>"))
    with pytest.raises(ValueError):
        t.add(spark.createDataFrame([(9, [0.0])], "key long, vector array<double>"))
    t = t.remove(spark.createDataFrame([(0,), (0,), (7,)], "key long"))
    assert len(t) == 3
    with pytest.raises(ValueError):
        t.rename(spark.createDataFrame([(1, 2)], "old long, new long"))
    t = t.rename(spark.createDataFrame([(1, 10)], "old long, new long"))
    assert [r.key for r in t.keys().collect()] == [2, 3, 10]
    assert {r.key: r.n for r in t.count(spark.createDataFrame([(2,), (5,)], "key long")).collect()} == {2: 1, 5: 0}
    assert len(t.clear()) == 0


def test_save_load_view(spark, tmp_path):
    t = VectorTable(Config(2), spark.createDataFrame([(1, [1.0, 2.0])], "key long, vector array<float>"))
    t.save(f"file://{tmp_path}/t")
    assert VectorTable.metadata(spark, f"file://{tmp_path}/t")["size"] == 1
    view = VectorTable.restore(spark, f"file://{tmp_path}/t", view=True)
    with pytest.raises(ValueError):
        view.clear()
    assert VectorTable.restore(spark, f"file://{tmp_path}/none") is None


@pytest.mark.parametrize("suffix,rows,cols", [("fbin", 77, 3), ("ibin", 1, 97), ("dbin", 100, 4), ("hbin", 5, 2), ("bbin", 9, 3), ("i8bin", 9, 3)])
def test_matrix_files(spark, tmp_path, suffix, rows, cols):
    x = np.arange(rows * cols, dtype=float).reshape(rows, cols)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vector array<double>").repartition(3)
    save_matrix(table, f"{tmp_path}/m", suffix)
    for _ in range(2):  # a second save replaces the first
        save_matrix(table, f"file://{tmp_path}/m", suffix)
    got = load_matrix(spark, f"{tmp_path}/m", rows_a_task=10).orderBy("key").collect()
    assert np.array_equal(np.array([r.vector for r in got]), x) and [r.key for r in got] == list(range(rows))
    part = load_matrix(spark, f"{tmp_path}/m", rows // 2, 3).orderBy("key").collect()
    assert [r.key for r in part] == list(range(rows // 2, min(rows, rows // 2 + 3))) and [r.vector for r in part] == x[rows // 2 : rows // 2 + 3].tolist()
    assert load_matrix(spark, f"{tmp_path}/none") is None


def test_matrix_file_of_a_wrong_size(spark, tmp_path):
    (tmp_path / "a.fbin").write_bytes(b"\2\0\0\0\3\0\0\0" + b"\0" * 20)
    with pytest.raises(ValueError, match="size"):
        load_matrix(spark, f"{tmp_path}/a.fbin")


def test_save_onto_the_path_that_was_loaded(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    VectorTable(Config(2), spark.createDataFrame([(1, [1.0, 2.0])], "key long, vector array<float>")).save(path)
    for i in range(2, 6):
        t = VectorTable.load(spark, path)
        t.add(spark.createDataFrame([(i, [0.0, 1.0])], "key long, vector array<double>")).save(path)
        assert len(VectorTable.load(spark, path)) == i == VectorTable.metadata(spark, path)["size"]
    assert len(t.keys().collect()) == 4 and VectorTable.serialized_length(spark, path) > 0  # the version before can still be read
    (tmp_path / "t" / "v000000009" / "rows").mkdir(parents=True)  # a save that failed half-way
    assert len(VectorTable.load(spark, path)) == 5
    with pytest.raises(FileNotFoundError):
        VectorTable.load(spark, f"{path}/none")


def test_append_update_and_copies(spark):
    frame = lambda rows: spark.createDataFrame(rows, "key long, vector array<double>")
    t = VectorTable.empty(spark, Config(1)).append(frame([(0, [float(i)]) for i in range(50)]).repartition(7).select("vector"))
    assert [r.key for r in t.keys().collect()] == list(range(50))
    with pytest.raises(ValueError):  # key 2 is the next number, and known
        VectorTable(Config(1), frame([(1, [0.0]), (2, [0.0])])).append(frame([(0, [1.0])]).select("vector"))
    with pytest.raises(ValueError):
        t.update(frame([(99, [0.0])]))
    new = t.update(frame([(3, [33.0]), (99, [99.0])]), insert=True)
    assert {r.key: r.vector for r in new.rows.collect() if r.key in (3, 4, 99)} == {3: [33.0], 4: [t.get(frame([(4, [0.0])])).first().vector[0]], 99: [99.0]}
    assert len(t) == 50 and len(t.copy()) == 50 and len(t.fork()) == 0 and t.fork().config == t.config
    multi = VectorTable(Config(1, multi=True), frame([(1, [1.0]), (1, [2.0]), (2, [3.0])])).update(frame([(1, [7.0]), (1, [8.0])]))
    assert sorted((r.key, r.vector[0]) for r in multi.rows.collect()) == [(1, 7.0), (1, 8.0), (2, 3.0)]
    assert t.capacity == 50 and t.memory_usage() == 50 * 12 and t.with_metric("ip").config.metric == "ip"
    assert [r.key for r in t.compact(3).keys(10, 12).collect()] == [10, 11]


def test_levels_of_all_keys(spark):
    keys = spark.createDataFrame([(k, [1.0]) for k in (0, 3_474_701_543, (1 << 32) - 1, 1 << 32, -1, -(1 << 63), (1 << 63) - 1)], "key long, vector array<double>")
    got = {r.key: r.lv for r in keys.select("key", cluster.level(F.col("key"), 4).alias("lv")).collect()}
    for k, lv in got.items():
        u = (((k % (1 << 32)) + 1) * 2654435761 % (1 << 32) + 0.5) / (1 << 32)
        assert lv == math.floor(-math.log(u) / math.log(4))
    assert cluster.level_stats(keys, 4).filter("level = 0").first().nodes == 7


def test_repeated_keys_stay_apart(spark):
    rows = [(i % 40, [float(i % 5) + 0.01 * i, 1.0]) for i in range(120)]
    x = spark.createDataFrame(rows, "key long, vector array<double>")
    index, centroids = ann.build(x, 4, "l2sq")
    assert index.count() == 120
    q = spark.createDataFrame([(7, [2.0, 1.0])], "query_id long, vector array<double>")
    got = ann.search(q, index, centroids, 9, 4, "l2sq").collect()
    want = sorted((v[0] - 2.0) ** 2 for _, v in rows)[:9]
    assert [r.distance for r in sorted(got, key=lambda r: r["rank"])] == pytest.approx(want)
    centers = np.array([[0.0, 1.0], [4.0, 1.0]])
    means = {(r.cluster, r.dim): r.value for r in cluster.update(cluster.assign(x, centers, "l2sq", "vector")).collect()}
    for c in (0, 1):
        own = [v for _, v in rows if (abs(v[0] - 4.0) < abs(v[0])) == bool(c)]
        assert means[c, 0] == pytest.approx(np.mean([v[0] for v in own]))
    assert cluster.kmeans(x, 3)[0].count() == 120


def test_vectors_of_other_lengths_raise(spark):
    x = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], "key long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    for act in (lambda: knn.search(q, x, 1, "l2sq"), lambda: cluster.assign(x, np.array([[1.0, 2.0]])), lambda: knn.search(x.withColumnRenamed("key", "query_id"), x, 1)):
        with pytest.raises(Exception, match="different numbers of dimensions"):
            act().collect()


@pytest.mark.parametrize("kind", ["l2sq", "cos", "ip"])
def test_kmeans_is_lloyds(spark, kind):
    x = random_vectors(spark, 120, 6, "l2sq").repartition(3)
    rows = {r.key: np.array(r.vector) for r in x.collect()}
    first = np.array([rows[k] for k in range(4)])
    got, centroids = cluster.kmeans(x, 4, kind, max_iterations=3, inertia_threshold=-1, min_shifts=-1, first=first)
    c = first
    for _ in range(3):
        at = {k: int(np.argmin(knn.distances(kind, v[None, :], c)[0])) for k, v in rows.items()}
        own = [[rows[k] for k in rows if at[k] == i] for i in range(4)]
        c = np.array([np.sum(o, axis=0) if o else np.zeros(6) for o in own])
        if kind == "l2sq":
            c = c / np.array([[max(1, len(o))] for o in own])
        if kind == "cos":
            c = c / np.maximum(1e-300, np.linalg.norm(c, axis=1, keepdims=True))
    assert centroids == pytest.approx(c)
    assert {r.key: r.cluster for r in got.collect()} == {k: int(np.argmin(knn.distances(kind, v[None, :], c)[0])) for k, v in rows.items()}
    assert cluster.kmeans(x, 4, max_seconds=0.0)[1].shape == (4, 6)
    assert cluster.kmeans(x, 4, prepare=quantize.to_i8)[0].count() == 120


def test_merging_of_centroids():
    """The least popular joins its nearest, takes its members along, and can be merged again."""
    vectors = {1: np.array([0.0]), 2: np.array([1.0]), 3: np.array([10.0]), 4: np.array([11.5])}
    assert cluster.merged({1: 5, 2: 1, 3: 9, 4: 2}, vectors, 2, "l2sq") == {1: 1, 2: 1, 3: 3, 4: 3}
    assert cluster.merged({1: 2, 2: 1, 3: 9, 4: 8}, vectors, 2, "l2sq") == {1: 3, 2: 3, 3: 3, 4: 4}  # 2 into 1, then both into the nearest


def test_clusters_of_a_table(spark):
    x = written(random_vectors(spark, 400, 8), "points")
    t = VectorTable(Config(8), x)
    got = written(t.cluster(5, 6), "clusters")
    sizes = {r.centroid: r["size"] for r in cluster.popularity(got).collect()}
    assert 1 <= len(sizes) <= 6 and sum(sizes.values()) == 400
    rows = {r.key: np.array(r.vector) for r in x.collect()}
    for r in got.collect():
        assert r.distance == pytest.approx(knn.distances("cos", rows[r.key][None, :], rows[r.centroid][None, :])[0, 0], abs=1e-9)
    big = max(sizes, key=sizes.get)
    assert cluster.members_of(got, big).count() == sizes[big]
    assert cluster.subcluster(x, got, big, min_count=2, max_count=3).count() == sizes[big]
    nodes, edges = cluster.network(x, got)
    assert nodes.count() == len(sizes) and edges.count() == len(sizes) * (len(sizes) - 1) // 2
    assert {r.level: (r.edges, r.max_edges) for r in t.stats(4).collect()}[0] == (400 * 8, 400 * 8)
    with pytest.raises(ValueError, match="too few"):
        cluster.cluster(x.filter("key < 2"), 2, 3)


def test_sql_kinds_and_errors(spark):
    register(spark)
    one_ = lambda q: spark.sql(f"SELECT {q} AS x").first().x
    assert one_("distance_sqeuclidean_f64('[0.1]', '[0]')") == 0.1 * 0.1 != one_("distance_sqeuclidean_i8('[0.1]', '[0]')") == float(np.float32(0.1)) ** 2
    assert one_("distance_sqeuclidean_i8(X'01FF', X'0101')") == 4 and one_("distance_cosine_i8(X'0100', X'0001')") == 0 and one_("distance_cosine_f64('1,0', '0,1')") == 1
    assert one_("distance_inner_f32(1.5, 2, 2, 1)") == 1 - 5 and one_("distance_sqeuclidean_f32(X'0000803F', CAST(NULL AS BINARY))") is None
    for bad in ("distance_sqeuclidean_f64('[1]', '[1,2,3]')", "distance_cosine_f32(X'0000803F', X'00')", "distance_divergence_i8(X'01', X'02')", "distance_inner_f64(1, 2, 3)", "distance_levenshtein_unicode('a', 'b', -1)", "distance_inner_f64('a', 'b', 'c', 'd')"):
        with pytest.raises(Exception, match="dimensions|size|divergence|even|negative|numbers"):
            one_(bad)
    with pytest.raises(ValueError, match="negative"):
        strings.levenshtein_bytes(F.lit("a"), F.lit("b"), -1)


def test_casts_between_all_kinds(spark):
    x = spark.createDataFrame([(0, [0.25, -0.5, 0.0, 1.0])], "key long, vector array<float>")
    known = {"f64": [0.25, -0.5, 0.0, 1.0], "f32": [0.25, -0.5, 0.0, 1.0], "f16": [0.25, -0.5, 0.0, 1.0], "bf16": [0.25, -0.5, 0.0, 1.0], "b1": [9 << 60 if 9 << 60 < 1 << 63 else (9 << 60) - (1 << 64)]}
    for a in quantize.KINDS:
        stored = written(x.select(quantize.cast(F.col("vector"), "f32", a, 4).alias("v")), "kind")
        if a in known:
            assert stored.first().v == known[a]
        for b in quantize.KINDS:
            got = stored.select(quantize.cast(F.col("v"), a, b, 4).alias("v")).first().v
            signs = [1, 0, 0, 1] if a == "b1" else None
            if b == "b1":
                assert got == known["b1"]
            elif b == "i8":
                assert [v > 0 for v in got] == [True, False, False, True] and max(map(abs, got)) <= 127
            elif a == "b1":
                assert got == signs
            elif a != "i8":
                assert got == known["f32"]
    with pytest.raises(ValueError):
        quantize.cast(F.col("v"), "f32", "i16", 4)
    assert one(spark, quantize.from_i8(F.array(F.lit(127).cast("tinyint"), F.lit(-64).cast("tinyint")))) == pytest.approx([1.0, -64 / 127])


def test_metrics_of_ones_own_and_quality(spark):
    x = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(8)], "key long, vector array<double>")
    q = x.filter("key = 3").select(F.col("key").alias("query_id"), "vector")
    far = lambda a, b: F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0))) * 2
    found = knn.search(q, x, 3, far)
    assert [(r.key, r.distance) for r in found.orderBy("rank").collect()] == [(3, 0.0), (2, 2.0), (4, 2.0)]
    assert quality.self_recall(found).first().recall == 1.0
    assert quality.mean_recall(found, spark.createDataFrame([(3, 2), (3, 7)], "query_id long, key long")).first().recall == 0.5
    again = ann.search_once(q, x, 3, "l2sq", expansion=8, lists=2)
    assert [r.key for r in again.orderBy("rank").collect()] == [3, 2, 4]
    index, centroids = ann.build(x, 2, "l2sq")
    assert 0 <= ann.efficiency(q, index, centroids, 1, "l2sq") <= 1


def test_search_per_group_and_ties(spark):
    x = spark.createDataFrame([(i, [float(i % 7), 1.0], [None, "a", "b"][i % 3]) for i in range(90)], "key long, vector array<double>, g string")
    q = x.filter("key < 2").select(F.col("key").alias("query_id"), "vector")
    got, want = (sorted((r.query_id, str(r.g), r["rank"], r.key) for r in knn.search(q, x, 4, "l2sq", per="g", native=n).collect()) for n in (False, True))
    assert got == want and len(got) == 2 * 3 * 4
    many = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(500)], "key long, vector array<double>").coalesce(1)
    assert [r.key for r in knn.search(q, many, 5, "l2sq").filter("query_id = 0").orderBy("rank").collect()] == [0, 2, 4, 6, 8]


def test_stream_within(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")], "query_id long, vector array<double>, bucket string")
    rows.write.parquet(f"{tmp_path}/in")
    table = spark.createDataFrame([(7, [1.0, 0.1], "a"), (8, [-1.0, 0.0], "a"), (9, [1.0, 0.0], "b")], "key long, vector array<double>, bucket string")
    found = within(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), table, "bucket", 0.5)
    found.writeStream.format("memory").queryName("near").trigger(availableNow=True).start().awaitTermination()
    assert [(r.query_id, r.key) for r in spark.sql("SELECT * FROM near").collect()] == [(1, 7)]


def test_arrays_in_and_padded_results_out(spark):
    x = np.arange(24, dtype=np.float32).reshape(8, 3)[::2]
    rows = from_arrays(spark, x, [5, 6, 7, 8])
    assert dict(rows.dtypes)["vector"] == "array<float>" and {r.key: r.vector for r in rows.collect()}[6] == [6.0, 7.0, 8.0]
    assert from_arrays(spark, np.float16([1, 2])).first().vector == [1.0, 2.0]
    with pytest.raises(ValueError):
        from_arrays(spark, x, [1])
    q = from_arrays(spark, x[:2]).withColumnRenamed("key", "query_id")
    ids, keys, distances, counts = padded(knn.search(q, rows, 6, "l2sq"), 6)
    assert ids.tolist() == [0, 1] and keys[0].tolist() == [5, 6, 7, 8, 0, 0] and counts.tolist() == [4, 4] and np.isnan(distances[:, 4:]).all() and distances[0, 0] == 0


def test_evaluation(spark, tmp_path):
    data = Dataset.build(spark, count=60, ndim=8)
    got = evaluate(Config(8, metric="ip"), data, 1)
    assert got.recall == 1.0 and set(got.seconds) == {"add", "search"} and data.crop(10).rows.count() == 10
    save_matrix(data.rows, f"{tmp_path}/v", "fbin")
    save_matrix(data.rows.select("key", F.array(F.col("key").cast("double")).alias("vector")), f"{tmp_path}/t", "ibin")
    stored = Dataset.build(spark, f"{tmp_path}/v", None, f"{tmp_path}/t")
    assert evaluate(Config(8), stored, 1).recall == 1.0
    with pytest.raises(ValueError):
        evaluate(Config(8), data, tasks=["fly"])


def test_generated_vectors(spark):
    a, b = (random_vectors(spark, 50, 300).collect() for _ in range(2))
    assert a == b and all(abs(sum(v * v for v in r.vector) - 1) < 1e-9 for r in a)
    assert max(random_vectors(spark, 9, 8, dtype="i8").first().vector) <= 100 and len(random_vectors(spark, 9, 70, dtype="b1").first().vector) == 2


def test_stable_match_is_greedy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((7, 3)), rng.random((9, 3))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vector array<double>")
    got = {(r.left_key, r.right_key) for r in join.stable_match(frame(a), frame(b), "l2sq", 9).collect()}
    edges = sorted((((u - v) ** 2).sum(), i, j) for i, u in enumerate(a) for j, v in enumerate(b))
    want, men, women = set(), set(), set()
    for _, i, j in edges:
        if i not in men and j not in women:
            want.add((i, j))
            men.add(i)
            women.add(j)
    assert got == want


def test_kmeans_and_clusters(spark):
    x = random_vectors(spark, 100, 10)
    assigned, centroids = cluster.kmeans(x, 5)
    assert centroids.shape == (5, 10) and assigned.count() == 100
    assert {r.cluster for r in assigned.collect()} <= set(range(5))
    with pytest.raises(ValueError):
        cluster.kmeans(x, 1)
    got = cluster.cluster(random_vectors(spark, 500, 8), 3, 10)
    assert 1 <= cluster.popularity(got).count() <= 10


def test_inverted_lists_recall(spark):
    x = random_vectors(spark, 600, 16)
    q = x.filter("key % 50 = 0").select(F.col("key").alias("query_id"), "vector")
    index, centroids = ann.build(x, 8)
    exact = knn.search(q, x, 10).select("query_id", "key")
    assert exact.join(ann.search(q, index, centroids, 10, 6), ["query_id", "key"]).count() / exact.count() >= 0.9


def test_stream_upserts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, [1.0]), (1, 2, [2.0]), (2, 1, [3.0]), (2, 3, None)], "key long, seq long, vector array<double>")
    rows.write.parquet(f"{tmp_path}/in")
    upserts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in latest(spark.read.parquet(f"{tmp_path}/out")).collect()] == [(1, [2.0])]


@pytest.mark.parametrize("case", ["hot men", "hot women", "hot both", "ties"])
def test_stable_match_leaves_nobody_single(spark, case):
    """Without `proposals`; groups of equal vectors larger than the first lists, and many equal distances."""
    rng = np.random.default_rng(5)
    a, b = rng.random((30, 3)), rng.random((60, 3))
    a[:20] = a[0] if case in ("hot men", "hot both") else a[:20]
    b[10:40] = b[10] if case == "hot women" else a[0] if case == "hot both" else b[10:40]
    if case == "ties":
        a, b = rng.integers(0, 3, (30, 2)).astype(float), rng.integers(0, 3, (25, 2)).astype(float)
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vector array<double>")
    got = {(r.left_key, r.right_key) for r in join.stable_match(frame(a), frame(b), "l2sq").collect()}
    edges = sorted((round(float(((u - v) ** 2).sum()), 12), j, i) for i, u in enumerate(a) for j, v in enumerate(b))
    want, men, women = set(), set(), set()
    for _, j, i in edges:
        if i not in men and j not in women:
            want.add((i, j))
            men.add(i)
            women.add(j)
    assert len(want) == min(len(a), len(b)) and got == want


def test_string_distances_of_whole_texts(spark, tmp_path):
    """Changes anywhere in a text count; the last rows differ after the second word only."""
    texts = ["", "one", "zwei Wörter", "a  b\nécole ", None, "x y " + "été " * 300 + "été", "x y " + "été " * 300 + "other"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    def ham(a, b):
        return sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))

    want = {name: {} for name in ("levenshtein_bytes", "levenshtein_unicode", "hamming_unicode", "hamming_bytes", "sql_distance_strings")}
    for i, t in enumerate(texts):
        if t is not None:
            w = t.replace("\n", " ").split(" ")
            w += [""] * (len(w) < 2)
            lu, hb = [lev(a, b) for a, b in zip(w, w[1:], strict=False)], [ham(a.encode(), b.encode()) for a, b in zip(w, w[1:], strict=False)]
            ls, hs = [lev(a.encode(), b.encode()) for a, b in zip(w, w[1:], strict=False)], [ham(a, b) for a, b in zip(w, w[1:], strict=False)]
            want["levenshtein_unicode"][i], want["hamming_bytes"][i] = (sum(lu), sum(min(d, 4) for d in lu)), (sum(hb),)
            want["levenshtein_bytes"][i] = (sum(ls), sum(min(d, 3) for d in ls))
            want["hamming_unicode"][i] = (sum(hs), sum(min(d, 3) for d in hs))
            want["sql_distance_strings"][i] = (sum(ls), sum(min(d, 2) for d in hs))
    for name, rows in want.items():
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == len(rows) and {r.doc_id: tuple(r)[1:] for r in got} == rows, name
        assert rows[5] != rows[6]


def test_nearest_centroids_are_sought_in_tiles(monkeypatch):
    cells, known = [], knn.distances
    monkeypatch.setattr(cluster, "distances", lambda kind, q, x: cells.append(len(q) * len(x)) or known(kind, q, x))
    x = np.random.default_rng(3).standard_normal((1500, 4))
    centroids = np.concatenate([x[:700], x[:700] * 2, x[:1200]])  # ties in other tiles: the lowest number
    at, d = cluster._nearest(x, centroids, "l2sq")
    assert at[:1200].tolist() == [i if i < 700 else 1400 + i for i in range(1200)] and d[:1200].max() < 1e-12
    want = known("l2sq", x, centroids).min(axis=1)
    assert np.abs(d - want).max() < 1e-12 and max(cells) <= 1 << 20
    assert cluster._nearest(x[:0], centroids, "l2sq")[0].shape == (0,)


def test_members_of_a_level_in_several_blocks(spark, monkeypatch):
    x = written(random_vectors(spark, 400, 8), "points")
    find = lambda: sorted((r.key, r.centroid, round(r.distance, 9)) for r in cluster.cluster_by_level(x, 1, "cos", 4).collect())
    want = find()
    monkeypatch.setattr(cluster, "MEMBERS", 7)
    assert find() == want


def test_clusters_are_assigned_once(spark, monkeypatch):
    x = written(random_vectors(spark, 400, 8), "points")
    monkeypatch.setattr(cluster, "assign", lambda *a: pytest.fail("a second pass over all centroids"))
    got = cluster.cluster(x, 5, 6)
    assert got.columns == ["key", "centroid", "distance"] and got.count() == 400 and cluster.popularity(got).count() <= 6
    rng = np.random.default_rng(5)
    sizes, vectors = {k * 3: int(n) for k, n in enumerate(rng.integers(1, 9, 300))}, {k * 3: v for k, v in enumerate(rng.standard_normal((300, 4)))}
    alive, into = dict(sizes), {c: c for c in sizes}
    while len(alive) > 10:
        gone = min(alive, key=lambda c: (alive[c], -c))
        to = min((c for c in alive if c != gone), key=lambda c: (((vectors[c] - vectors[gone]) ** 2).sum(), c))
        alive[to] += alive.pop(gone)
        into = {c: to if e == gone else e for c, e in into.items()}
    assert cluster.merged(sizes, vectors, 10, "l2sq") == into


def test_network_ranks_nothing(spark, monkeypatch):
    x = written(random_vectors(spark, 300, 8), "points")
    clusters = cluster.cluster_by_level(x, 1, "cos", 4)
    monkeypatch.setattr(cluster, "MEMBERS", 20)
    nodes, edges = cluster.network(x, clusters)
    assert "Window" not in edges._jdf.queryExecution().executedPlan().toString()
    names, rows = {r.centroid for r in nodes.collect()}, {r.key: np.array(r.vector, dtype=float) for r in x.collect()}
    got = {(r.a, r.b): r.distance for r in edges.collect()}
    assert len(names) > 40 and edges.count() == len(got) and set(got) == {(a, b) for a in names for b in names if a < b}
    assert all(d == pytest.approx(knn.distances("cos", rows[a][None, :], rows[b][None, :])[0, 0], abs=1e-9) for (a, b), d in got.items())


def test_search_keeps_little_at_once(monkeypatch):
    cells, known, rng = [], knn.distances, np.random.default_rng(7)
    monkeypatch.setattr(knn, "distances", lambda kind, q, x: cells.append(len(q) * len(x)) or known(kind, q, x))
    q, x, key = rng.integers(0, 3, (1500, 4)).astype(float), rng.integers(0, 3, (2500, 4)).astype(float), rng.permutation(2500)  # many ties
    for k in (1, 7, 3000):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(x[at].tolist(), pa.list_(pa.float64()))], names=["key", "vector"]) for at in np.split(np.arange(2500), [0, 3, 2100])]
        got = pa.Table.from_batches(list(knn._block_knn(np.arange(len(q)), q[: 1500 if k < 99 else 20], "l2sq", k)(iter(batches)) if k < 99 else knn._block_knn(np.arange(20), q[:20], "l2sq", k)(iter(batches)))).to_pandas()
        d = known("l2sq", q, x)
        for i, mine in got.groupby("query_id"):
            want = np.lexsort((key, d[i]))[:k]
            assert mine.key.tolist() == key[want].tolist() and mine.distance.tolist() == d[i][want].tolist()
        assert got.query_id.nunique() == (1500 if k < 99 else 20)
    assert max(cells) <= 1 << 20


def test_distances_to_keys_and_within_a_radius_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 3)
    rng = np.random.default_rng(9)
    x = spark.createDataFrame([(i, rng.standard_normal(4).tolist() if i % 9 else None, [None, "a", "b", "c"][i % 4], i % 5) for i in range(120)], "id long, vector array<double>, g string, label int")
    q = x.filter("id % 7 = 0").select(F.col("id").alias("query_id"), "vector", "g")
    q = q.unionByName(q.filter("query_id % 2 = 1").withColumn("vector", F.transform("vector", lambda v: -v)))  # ids of two vectors
    pairs = q.select("query_id", (F.col("query_id") % 7).cast("int").alias("key")).unionByName(q.limit(2).select("query_id", F.lit(3).alias("key")))  # some keys missing, some pairs twice
    y = x.select(F.col("label").alias("key"), "vector")
    rows = lambda df: sorted(tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in df.collect())
    for kind in ("cos", "l2sq"):
        got = knn.key_distances(q.select("query_id", "vector"), y, pairs, kind)
        want = knn.pairwise(q.select(F.col("query_id").alias("key"), "vector"), y, pairs.select(F.col("query_id").alias("left_key"), F.col("key").alias("right_key")), kind)
        assert [str(r) for r in rows(got)] == [str(r) for r in rows(want)] and got.columns == ["query_id", "key", "n", "mean", "min", "max"]
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
        t = x.select(F.col("id").alias("key"), "vector", "g")
        found = within(q, t, "g", 0.9, kind)
        joined = q.withColumnRenamed("vector", "q").join(t, "g").select("query_id", "key", metrics.metric(kind)(F.col("q"), F.col("vector")).alias("distance")).filter("distance <= 0.9")
        assert rows(found) == rows(joined) and found.count() > 10 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert within(q.limit(0), t, "g", 0.9).count() == 0


def test_hamming_takes_a_batch_at_once(monkeypatch):
    monkeypatch.setattr(strings, "STEP", 3)
    a, b = ["école", "", None, "abc", "naïve", "", "€uro", "x" * 90], ["écolé", "ab", "x", "abd", "naive", "", "euro", None]
    want = [[None if x is None or y is None else sum(u != v for u, v in zip(x, y)) + abs(len(x) - len(y)) for x, y in zip(p, q)] for p, q in ((a, b), *[[[t if t is None else t.encode() for t in s] for s in (a, b)]])]
    for by_bytes in (False, True):
        assert strings._differing(by_bytes)(pa.array(a), pa.array(b)).to_pylist() == want[by_bytes]
        assert strings._differing(by_bytes)(pa.array(a)[2:], pa.array(b)[2:]).to_pylist() == want[by_bytes][2:]
    assert strings._differing(True)(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []
