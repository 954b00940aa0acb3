import hashlib
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe import schemas
from axisframe.operators import annotate as A
from axisframe.operators import labels, summaries
from axisframe.operators.contracts import ContractError
from axisframe.sources import readers, sinks
from axisframe.streaming import ingest

ROW = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("status", T.StringType()),
                    T.StructField("present", T.ArrayType(T.StringType()))])


# ---- summaries -------------------------------------------------------------

def test_seed_deviation_is_a_sample_one(spark):
    df = spark.createDataFrame([("f", 1, 0, 1.0), ("f", 1, 1, 3.0), ("g", 1, 0, 5.0)],
                               "family string, size int, seed int, value double")
    got = {r["family"]: r for r in summaries.seed_summary(df).collect()}
    assert got["f"]["mean"] == 2.0 and got["f"]["sample_std"] == pytest.approx(2 ** .5)
    assert got["g"]["sample_std"] == 0.0


def test_diverse_examples(spark):
    rows = [(0, "apple/a"), (1, "apple/b"), (2, "ball/a"), (3, "car/a"), (4, "apple/c")]
    df = spark.createDataFrame([("n", p, i) for p, i in rows], "name string, pos int, image_id string")
    for k, want in ((3, ["apple/a", "ball/a", "car/a"]), (5, ["apple/a", "ball/a", "car/a", "apple/b", "apple/c"])):
        got = summaries.diverse_examples(df, k).orderBy("place").collect()
        assert [r["image_id"] for r in got] == want


def test_telemetry(spark):
    values = np.random.default_rng(0).random(501) * 120
    df = spark.createDataFrame([("gpu", float(v)) for v in values], "metric string, value double")
    row = summaries.telemetry_summary(df).head()
    assert row["p95"] == pytest.approx(np.quantile(values, .95)) and row["max"] == values.max()
    assert row["busy_pct"] == pytest.approx(100 * (values >= 90).mean())


def test_chart_needs_equal_cohorts(spark):
    summary = spark.createDataFrame([("f", 1, .5, .1)], "family string, size int, mean double, sample_std double")
    cohorts = spark.createDataFrame([("f", 1, 10), ("g", 1, 11)], "family string, size int, images long")
    with pytest.raises(Exception, match="different numbers of images"):
        summaries.chart_series(summary, cohorts).collect()


def test_label_diagnostics_count_absent_concepts(spark):
    df = spark.createDataFrame([("a", ["red"], []), ("b", [], ["red"])],
                               "image_id string, present array<string>, uncertain array<string>")
    row = labels.label_diagnostics(df, ["red", "shiny"]).head()
    assert (row["rows"], row["concepts"], row["min_positives"], row["min_definite"]) == (2, 2, 0, 1)
    assert row["positive_rate"] == row["uncertain_rate"] == .25


# ---- hooks -----------------------------------------------------------------

def test_annotator_errors_become_rows(spark):
    def broken(batch, attempt, budget):
        if attempt == 1:
            raise RuntimeError("down")
        return [("ok", False) if p == "good" else ("no", False) for p in batch["prompt"]]

    items = spark.createDataFrame([("1", "good"), ("2", "bad")], "image_id string, prompt string")
    got = {r["image_id"]: r for r in A.annotate(
        items, broken, lambda t: None if t == "ok" else "refused", retries=2).collect()}
    assert got["1"]["status"] == "ok" and got["1"]["attempts"] == 2
    assert got["1"]["errors"] == ["attempt 1: RuntimeError: down"]
    assert got["2"]["status"] == "error" and got["2"]["errors"][-1] == "attempt 2: refused"


def test_truncation_gets_a_larger_budget(spark):
    def short(batch, attempt, budget):
        return [(str(budget), budget < 64) for _ in range(len(batch))]

    items = spark.createDataFrame([("1", "x")], "image_id string, prompt string")
    row = A.annotate(items, short, lambda t: None, retries=2, budget=16, retry_budget=64).head()
    assert row["content"] == "64" and row["attempts"] == 2


def test_failing_batches_are_halved(spark):
    edges = spark.createDataFrame([(f"e{i}", "a", "b") for i in range(8)], "edge_id string, left string, right string")

    def small_only(batch: pd.DataFrame):
        if len(batch) > 2:
            raise ValueError("too long")
        return {e: e != "e3" for e in batch["edge_id"]}

    got = {r["edge_id"]: r["equivalent"] for r in A.adjudicate_edges(edges.coalesce(1), small_only, retries=1).collect()}
    assert got == {f"e{i}": i != 3 for i in range(8)}
    with pytest.raises(Exception, match="no valid decision on edge"):
        A.adjudicate_edges(edges, lambda b: {}, retries=1).collect()


# ---- sources ---------------------------------------------------------------

def test_annotation_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"image_id":"a","attributes":[]}\n\n{"image_id":"b","attributes":["x"]}\n{oops\n')
    rows, bad = readers.src_annotations(spark, str(tmp_path), schemas.TAG_ROW)
    assert {r["image_id"]: r["attributes"] for r in rows.collect()} == {"a": [], "b": ["x"]}
    assert [r["line"] for r in bad.collect()] == ["{oops"]


@pytest.mark.parametrize(("layout", "indent"), [("lines", 2), ("document", None), ("document", 1), ("lines", None)])
def test_id_manifest(spark, tmp_path, layout, indent):
    ids = [f'cls/{i} "x"' for i in range(50)]
    (tmp_path / "ids.json").write_text(json.dumps(ids, indent=indent))
    rows = readers.src_id_manifest(spark, str(tmp_path / "ids.json"), layout).orderBy("pos").collect()
    assert [r["image_id"] for r in rows] == ids and [r["pos"] for r in rows] == list(range(50))


@pytest.mark.parametrize(("text", "match"), [
    ('["a",\n"b", "c",\n"a"]', "listed twice"), ('[\n"a",\nb\n]', "not a line of quoted ids"), ('["a", 5]', "not a line")])
def test_bad_id_manifests(spark, tmp_path, text, match):
    (tmp_path / "ids.json").write_text(text)
    with pytest.raises(Exception, match=match):
        readers.src_id_manifest(spark, str(tmp_path / "ids.json")).collect()


def test_several_ids_on_a_line(spark, tmp_path):
    (tmp_path / "ids.json").write_text('["a", "b,",\n  "c]", "[d" ,\n\n "e"\n]')
    rows = readers.src_id_manifest(spark, str(tmp_path / "ids.json")).orderBy("pos").collect()
    assert [r["image_id"] for r in rows] == ["a", "b,", "c]", "[d", "e"]


def test_split_manifest_checks(spark, tmp_path):
    path = tmp_path / "splits.json"
    path.write_text(json.dumps({"unit": "object", "classes": {"cup": "train", "jar": "other"}}))
    with pytest.raises(Exception, match="unknown split"):
        readers.src_split_manifest(spark, str(path), "object").collect()
    with pytest.raises(Exception, match="must use unit"):
        readers.src_split_manifest(spark, str(path), "image").collect()


def test_dictionary_rules(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps([{"name": "red", "members": ["red", "scarlet"]}, {"name": "red", "members": ["scarlet"]}]))
    d = readers.src_dictionary(spark, str(path))
    assert [r["concept_idx"] for r in d.orderBy("concept_idx").collect()] == [0, 1]
    assert {tuple(r) for r in readers.dictionary_violations(d).collect()} == {
        ("duplicate_name", "red", 2), ("shared_member", "scarlet", 2)}


def test_images_and_checksums(spark, tmp_path):
    for name in ("b/1.JPG", "a.png", "a/2.jpeg", "a/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    assert [r["image_id"] for r in readers.list_images(spark, str(tmp_path)).collect()] == ["a.png", "a/2.jpeg", "b/1.JPG"]
    sums = {r["artifact"]: r["sha256"] for r in readers.file_checksums(spark, str(tmp_path)).collect()}
    assert sums["a.png"] == hashlib.sha256(b"a.png").hexdigest()


def test_wide_names_with_dots_survive(spark):
    long = spark.createDataFrame([("i", "3.5-inch", .25), ("i", "red", .5)], "image_id string, concept string, score double")
    wide = readers.long_to_wide_scores(long, ["red", "3.5-inch"])
    assert wide.columns == ["image_id", "s_red", "s_3.5-inch"]
    assert {tuple(r) for r in readers.wide_to_long_scores(wide).collect()} == {tuple(r) for r in long.collect()}


def test_embeddings_must_be_floats(spark, tmp_path):
    spark.createDataFrame([([1, 2],)], "embedding array<int>").write.parquet(str(tmp_path / "e"))
    with pytest.raises(ValueError):
        readers.src_embeddings(spark, str(tmp_path / "e"))


def test_routing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ok", ["x"]), ("b", "error", None)], ROW)
    sinks.route_ok_error(rows, str(tmp_path / "out"))
    assert [r["image_id"] for r in sinks.read_routed(spark, str(tmp_path / "out"), ROW, "error").collect()] == ["b"]


# ---- incremental -----------------------------------------------------------

def drop(path, rows):
    path.write_text("".join(json.dumps(dict(zip(ROW.names, r))) + "\n" for r in rows))


def test_ingest_reads_each_file_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run():
        return ingest.ingest_annotations_stream(spark, str(source), target, str(tmp_path / "cp"), ROW)

    drop(source / "1.json", [("a", "ok", ["x"]), ("b", "error", None)])
    assert run() == 1
    drop(source / "2.json", [("b", "ok", ["y"]), ("a", "ok", ["z"]), ("c", "ok", []), ("c", "ok", [])])
    assert run() == 1 and run() == 0
    read = lambda folder: sorted(r["image_id"] for r in ingest.read_ingested(spark, target, ROW, folder).collect())
    assert read("ok") == ["a", "b", "c"] and read("errors") == ["b"] and read("duplicates") == ["a", "c"]


def test_ingest_keeps_its_state_without_python_calls(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n in range(3):
        (source / f"{n}.json").write_text("".join(
            '{"image_id": "%s", "status": "ok", "present": ["%d"]}\n' % (i, n) for i in ("hot", f"own{n}") * (n + 1)))
        os.utime(source / f"{n}.json", (1000 + n, 1000 + n))
    plan = ingest._settled(ingest._lines(spark, str(source), ROW, 1))._jdf.queryExecution().logical().toString()
    assert "Aggregate" in plan and "WithState" not in plan
    target = str(tmp_path / "out")
    assert ingest.ingest_annotations_stream(spark, str(source), target, str(tmp_path / "cp"), ROW, max_files=1) == 3
    read = lambda folder: sorted(
        (r["image_id"], r["batch"]) for r in ingest.read_ingested(spark, target, ROW, folder).collect())
    assert read("ok") == [("hot", 0), ("own0", 0), ("own1", 1), ("own2", 2)]
    assert read("duplicates") == [("hot", 1), ("hot", 2), ("own1", 1), ("own2", 2)]


def test_ingest_keeps_the_earliest_success_and_broken_lines(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    drop(source / "1.json", [("a", "ok", ["first"]), ("a", "ok", ["a later line"]), (None, "ok", ["no id"]),
                             ("e", None, None)] + [("hot", "ok", [str(i)]) for i in range(3000)])
    with open(source / "1.json", "a") as file:
        file.write('{"image_id": "x", "status"\n\n   \n{"image_id": "y", "status": "ok", "present": 3}\n')
    drop(source / "2.json", [("a", "ok", ["another file"]), ("b", "ok", ["b"])])
    os.utime(source / "1.json", (1_700_000_000, 1_700_000_000))
    drop(source / "0.json", [("b", "ok", ["younger file"])])
    os.utime(source / "2.json", (1_700_000_500, 1_700_000_500))
    run = lambda cp: ingest.ingest_annotations_stream(spark, str(source), target, str(tmp_path / cp), ROW)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert run("cp") == 1 and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    ok = {r["image_id"]: r["present"] for r in ingest.read_ingested(spark, target, ROW).collect()}
    assert ok == {"a": ["first"], "b": ["b"], "hot": ["0"]}
    line = T.StructType([T.StructField("line", T.StringType())])
    broken = sorted(r["line"] for r in ingest.read_ingested(spark, target, line, "broken").collect())
    assert broken == sorted(['{"image_id": "x", "status"', '{"image_id": "y", "status": "ok", "present": 3}',
                             json.dumps(dict(zip(ROW.names, (None, "ok", ["no id"]))))])
    again = [r["image_id"] for r in ingest.read_ingested(spark, target, ROW, "duplicates").collect()]
    assert sorted(again) == ["a", "b", "hot"]
    assert [r["image_id"] for r in ingest.read_ingested(spark, target, ROW, "errors").collect()] == ["e"]
    # An older file that arrives later does not replace what is stored, and nothing stored is read again.
    for name in ("ok", "errors", "duplicates", "broken"):
        os.rename(f"{target}/{name}/batch=0", f"{tmp_path}/away-{name}")
    drop(source / "3.json", [("a", "ok", ["late"]), ("c", "ok", ["c"])])
    os.utime(source / "3.json", (1_600_000_000, 1_600_000_000))
    assert run("cp") == 1
    assert [r["image_id"] for r in ingest.read_ingested(spark, target, ROW).collect()] == ["c"]
    assert [r["image_id"] for r in ingest.read_ingested(spark, target, ROW, "duplicates").collect()] == ["a"]
    with pytest.raises(ContractError, match="new checkpoint"):
        run("another")


def test_repeated_success_keeps_the_first(spark):
    rows = spark.createDataFrame([("a", "ok", ["z"], 1), ("a", "ok", ["b"], 2), ("b", "ok", ["k"], 3), ("c", "error", None, 4)],
                                 "image_id string, status string, attributes array<string>, line long")
    none = rows.where("false")
    fresh, twice = ingest.reject_duplicate_success(rows, none, ["line"])
    assert {r["image_id"]: r["line"] for r in fresh.collect()} == {"a": 1, "b": 3}
    assert [r[0] for r in twice.collect()] == ["a"]
    fresh, twice = ingest.reject_duplicate_success(rows, rows.where("image_id = 'b'"))
    assert {r["image_id"]: r["attributes"] for r in fresh.collect()} == {"a": ["b"]}
    assert sorted(r[0] for r in twice.collect()) == ["a", "b"]


def test_resume_guard(spark, tmp_path):
    meta, out = str(tmp_path / "meta"), str(tmp_path / "out")
    base = {"prompt": "v1", "run_id": None}
    ingest.resume_compatibility(spark, meta, out, base)
    ingest.resume_compatibility(spark, meta, out, base)
    ingest.resume_compatibility(spark, meta, out, {**base, "transport": "base64"}, {"transport": "base64"})
    with pytest.raises(ContractError, match="differs from the one"):
        ingest.resume_compatibility(spark, meta, out, {**base, "prompt": "v2"})
    spark.createDataFrame([("a", "ok", [])], ROW).write.parquet(out)
    with pytest.raises(ContractError, match="without metadata of their run"):
        ingest.resume_compatibility(spark, str(tmp_path / "other"), out, base)


# ---- the registered queries ------------------------------------------------

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).where(F.col("rank") == 1).count() == 1
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", [
    "attribute_support", "cluster_leader", "explicit_id_list", "validate_open_tags", "parse_label_json",
    "merge_violations", "project_scores", "quality_gates", "recall_curve", "concept_auroc", "batch_ema_means",
    "telemetry_summary", "select_concepts", "connected_components", "ingest_annotations_stream"])
def test_query_equals_sql(spark, name):
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from check_parity import TABLES, rows_of

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    df = queries()[name](spark, SF)
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_id_files_are_written_by_many_tasks(spark, tmp_path):
    from axisframe.plans import io_queries

    rows = [(i, f"src{i % 20}") for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    path = io_queries._written_ids(spark, str(tmp_path))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()
    assert len(files) == 160
    # A file is named by the task that wrote it.
    assert len({r["path"].rsplit("/", 1)[1].split("-")[1] for r in files}) > 4
