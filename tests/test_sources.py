"""Sources, sinks, provenance, exports and the stream."""

import json
import os
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from biblioscope.sources import api, export, files, provenance
from biblioscope.streaming import scoring


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, None)], "id int, t string")
    for kind in ("csv", "parquet"):
        base = f"file://{tmp_path}/{kind}/t"
        files.write_table(df, base, kind)
        assert sorted(map(tuple, files.read_any(spark, base, df.schema).collect())) == [(1, 'a "q", b\nc'), (2, None)]
    assert files.read_csv(spark, f"file://{tmp_path}/csv/t.csv", columns=["id"]).columns == ["id"]
    with pytest.raises(FileNotFoundError):
        files.read_any(spark, f"file://{tmp_path}/none")
    files.appended(df, f"file://{tmp_path}/parquet/t.parquet")
    assert spark.read.parquet(f"file://{tmp_path}/parquet/t.parquet").count() == 4


def test_lists_tasks_and_annotations(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("S1\n\n# no\n  S2 \n")
    assert {r.id for r in files.read_ids(spark, f"file://{tmp_path}/ids.txt").collect()} == {"S1", "S2"}
    df = spark.createDataFrame([("w1", None)], "id string, titulo string")
    assert json.loads(files.annotation_tasks(df, ["id", "titulo", "missing"]).first().task) == {"data": {"id": "w1", "titulo": None}}
    files.write_annotation_tasks(df, ["id"], f"file://{tmp_path}/tasks")
    (tmp_path / "export.json").write_text(json.dumps([{"id": 1, "data": {"id": "w1"}, "annotations": [{"completed_by": {"email": "a"}, "result": [{"from_name": "x", "value": {"choices": ["1"]}}]}]}]))
    assert files.read_annotations(spark, f"file://{tmp_path}/export.json").first().annotations[0].result[0].value.choices == ["1"]
    files.write_report(df, f"file://{tmp_path}/report")
    assert '"titulo":null' in "".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    np.save(tmp_path / "m.npy", np.eye(2))
    ids = spark.createDataFrame([("a",), ("b",)], "doc_id string").coalesce(1)
    assert {r.doc_id: r.embedding for r in files.read_matrix(spark, str(tmp_path / "m.npy"), ids).collect()} == {"a": [1, 0], "b": [0, 1]}


def test_paging_and_retries():
    calls, waits = [], []

    def fetch(url):
        calls.append(url)
        if len(calls) == 2:
            raise OSError
        return {"results": [{"id": len(calls)}], "meta": {"next_cursor": "c" if len(calls) < 3 else None}}

    assert [w["id"] for w in api.pages("http://x", "S1", (2000, 2024), "article", fetch, waits.append)] == [1, 3]
    assert waits == [2.0] and "cursor=%2A" in calls[0] and "publication_year%3A2000-2024" in calls[0]

    def broken(url):
        raise OSError

    waits.clear()
    assert list(api.pages("http://x", "S1", (2000, 2024), "article", broken, waits.append)) == [] and waits == [2, 4, 8, 16]


def test_data_source(spark, tmp_path):
    for s in ("S1", "S2"):
        (tmp_path / f"{s}.jsonl").write_text("".join(json.dumps({"id": f"{s}-{i}"}) + "\n" for i in range(3)))
    spark.dataSource.register(api.WorksSource)
    df = spark.read.format("works").option("url", f"file://{tmp_path}").option("sources", "S1,S2").load()
    assert df.rdd.getNumPartitions() == 2
    assert {r.id for r in df.select(F.get_json_object("work", "$.id").alias("id")).collect()} == {f"{s}-{i}" for s in ("S1", "S2") for i in range(3)}


def test_provenance(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert provenance.table_digest(df) == provenance.table_digest(df.orderBy(F.desc("id")).select("t", "id"))
    assert provenance.table_digest(df) != provenance.table_digest(df.filter("id = 1"))
    registry = tmp_path / "snapshot.json"
    digest = provenance.write_registered(df, f"file://{tmp_path}/t.parquet", registry, "test")
    assert json.loads(registry.read_text())[f"file://{tmp_path}/t.parquet"]["digest"] == digest
    registry.write_text("garbage")
    provenance.register(registry, "x", {"rows": 1})
    assert list(json.loads(registry.read_text())) == ["x"] and list(tmp_path.glob("snapshot.corrupt-*"))
    provenance.write_atomic(tmp_path / "f", b"abc")
    assert provenance.file_digest(tmp_path / "f") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_lock(tmp_path):
    got = []

    def other():
        try:
            with provenance.locked(tmp_path / "l", timeout=0.3):
                got.append("in")
        except TimeoutError:
            got.append("late")

    with provenance.locked(tmp_path / "l"):
        t = threading.Thread(target=other)
        t.start()
        t.join()
    other()
    assert got == ["late", "in"]


def test_exports(spark, tmp_path):
    predictions = spark.createDataFrame([("b", "si"), ("a", "ps")], "id string, cluster_primario_pred string")
    metadata = spark.createDataFrame([("a", 2001, "x")], "id string, ano int, ignored string")
    out = export.classified(predictions, metadata)
    assert out.columns == ["id", "ano", "cluster_primario_pred"] and [tuple(r) for r in out.collect()] == [("a", 2001, "ps"), ("b", None, "si")]
    (tmp_path / "f.txt").write_text("hi")
    manifest = export.bundle(tmp_path / "b.zip", {"f.txt": (str(tmp_path / "f.txt"), "text"), "gone": (str(tmp_path / "gone"), "")}, {"t.csv": (out, "table")}, tag="v1")
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        assert set(z.namelist()) == {"f.txt", "t.csv", "manifest.json"} and z.read("t.csv").decode().splitlines()[1] == "a,2001,ps"
    assert [m["file"] for m in manifest] == ["f.txt", "t.csv"]


def test_stream_resumes(spark, tmp_path):
    folder, sink = f"{tmp_path}/in", f"file://{tmp_path}/out"
    one = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, t string")
    one.write.parquet(folder)
    calls = []

    def score(df):
        calls.append(df.count())
        return df.select("id", F.length("t").alias("n"))

    def go(version, checkpoint):
        scoring.score_stream(spark.readStream.schema(one.schema).parquet(folder), score, sink, f"file://{tmp_path}/{checkpoint}", version).awaitTermination()

    go("v1", "c1")
    spark.createDataFrame([(2, "b"), (3, "c")], "id int, t string").write.mode("append").parquet(folder)
    go("v1", "c1")
    go("v1", "c2")  # a lost checkpoint scores nothing twice
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2, 3] and calls[:2] == [2, 1] and calls[2] == 0
    go("v2", "c3")
    assert spark.read.parquet(sink).count() == 6
    done = spark.read.parquet(sink).filter("id < 3 or prompt_version = 'v2'")
    assert [r.id for r in scoring.resumed(spark.createDataFrame([(1,), (3,)], "id int"), done, "v1").collect()] == [3]


def test_stored_tables_go_when_asked(spark, tmp_path):
    from biblioscope import storage

    storage.discard(spark)
    path = lambda df: df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    with storage.passing(spark):
        first = storage.stored(spark.range(3), "a")
        where = path(first)
        last = storage.stored(first.filter("id > 0"), "b")
    assert not os.path.exists(where) and last.count() == 2
    assert storage.discard(spark) == 1 and not os.path.exists(path(last)) and storage.discard(spark) == 0


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from biblioscope import storage

    class Conf:
        def __init__(self, master):
            self.own = {"spark.master": master}

        def get(self, key, default=None):
            return self.own.get(key, default)

        set = lambda self, key, value: self.own.__setitem__(key, value)

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    assert storage.shared_path(Session("local[2]"), "x").startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_path(Session(master), "x")
