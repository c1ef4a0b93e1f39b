import pytest

from gapweave.operators import segments as sg
from gapweave.operators import store
from gapweave.sources import artifacts, tsv


def put(root, stem, atlas, series, coverage):
    (root / f"{stem}_space-S_atlas-{atlas}_stat-mean_timeseries.tsv").write_text(series)
    (root / f"{stem}_space-S_atlas-{atlas}_stat-coverage_bold.tsv").write_text(coverage)


def test_full_and_censored_tables(spark, tmp_path):
    put(tmp_path, "sub-1_ses-1_task-rest", "A", "V1\tM1\n" + "".join(f"{i}\t{10 + i}\n" for i in range(5)), "Node\tcoverage\nV1\t1\nM1\t0.9\n")
    put(tmp_path, "sub-1_ses-1_task-rest", "B", "T\n0\n2\n3\n", "Node\tcoverage\nT\t0.2\n")
    (tmp_path / "sub-1_ses-1_task-rest_outliers.tsv").write_text("outlier\n0\n1\n0\n0\n1\n")
    got = [(r.frame, r.roi_idx, r.roi, r.x) for r in tsv.load(spark, str(tmp_path), ["A", "B"]).orderBy("frame", "roi_idx").collect()]
    assert got == [(f, *c) for f in (0, 2, 3) for c in ((0, "V1", float(f)), (1, "M1", 10.0 + f), (2, "T", float(f)))]
    with pytest.raises(ValueError, match="T of B"):
        tsv.load(spark, str(tmp_path), ["A", "B"], 0.5)
    some = tsv.load(spark, str(tmp_path), ["A", "B"], 0.5, ["M1", "V1"]).orderBy("frame", "roi_idx")
    assert [(r.frame, r.roi_idx, r.roi, r.x) for r in some.collect()] == [(f, *c) for f in (0, 2, 3) for c in ((0, "M1", 10.0 + f), (1, "V1", float(f)))]
    with pytest.raises(ValueError):
        tsv.load(spark, str(tmp_path), ["A", "B"], None, ["V1", "Z"])
    (tmp_path / "sub-1_ses-1_task-rest_outliers.tsv").unlink()
    with pytest.raises(ValueError):
        tsv.manifest(spark, str(tmp_path), ["A", "B"])


def test_json_is_strict(tmp_path):
    p = tmp_path / "a.json"
    artifacts.write_json({"x": 1}, str(p))
    assert artifacts.load_json(str(p)) == {"x": 1}
    with pytest.raises(FileExistsError):
        artifacts.write_json({}, str(p))
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        p.write_text(text)
        with pytest.raises(ValueError):
            artifacts.load_json(str(p))


def test_store_contract_append_and_fingerprint(spark, tmp_path):
    schema = "subject string, session string, segment_id long, start_frame long, end_frame long, values array<double>"
    a = spark.createDataFrame([("s1", "1", 0, 0, 1, [1.0, 3.0]), ("s1", "1", 0, 1, 2, [3.0, 5.0]), ("s1", "1", 1, 5, 6, [5.0, 7.0])], schema)
    b = spark.createDataFrame([("s2", "1", 0, 0, 1, [0.0, 0.0])], schema)
    c = store.contract([["x", "y"], ["x", "z"]], "window-fc:length=2;step=1;taper=uniform", 0.8)
    path = f"{tmp_path}/store"
    store.create(a, path, c)
    store.append(b, path, c)
    assert [(r.mean, r.n) for r in store.means(store.read(spark, path, ["s1"])).orderBy("feature_idx").collect()] == [(3.0, 3), (5.0, 3)]
    with pytest.raises(ValueError):
        store.append(b, path, c)
    with pytest.raises(ValueError):
        store.append(b, path, c | {"source_contract": "other"})
    assert store.data_fingerprint(store.read(spark, path), c) == store.data_fingerprint(a.unionByName(b), c)


def test_streaming_equals_batch(spark, tmp_path):
    from gapweave.streaming.segments import streaming_segments

    schema, frames = "subject string, session string, frame long", [0, 1, 2, 5, 6, 9]
    for k in (0, 1, 2):
        spark.createDataFrame([("a", "1", f) for f in frames[2 * k : 2 * k + 2]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streaming_segments(stream).writeStream.format("memory").queryName("seg").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = sg.segments(spark.createDataFrame([("a", "1", f) for f in frames], schema)).select("frame", "segment_id", "pos")
    got = spark.table("seg").select("frame", "segment_id", "pos")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
