"""Registered queries: sources and sinks as round trips, hooks and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe import schemas
from axisframe.functions import columns as C
from axisframe.operators import annotate as hooks
from axisframe.operators import contracts, joins
from axisframe.plans import inputs as I
from axisframe.plans.registry import query
from axisframe.plans.support_queries import _DICT, _dictionary
from axisframe.session import scratch_folder
from axisframe.sources import readers, sinks
from axisframe.streaming import ingest

r6 = I.r6


# ---- sources and sinks -----------------------------------------------------

def _written_lines(spark, sf):
    """Label rows as JSON lines; the lines of one source are cut short."""
    rows = I.label_shards(spark, sf).withColumn("image_id", F.col("image_id").cast("string"))
    origin = I.label_rows(spark, sf).select(F.col("image_id").cast("string").alias("image_id"),
                                            F.col("source").alias("_s"))
    line = F.to_json(F.struct("image_id", "status", "present", "uncertain"))
    cut = rows.join(origin, "image_id").select(F.when(
        F.col("_s") == "src7", F.substring(line, 1, 20)).otherwise(line).alias("value"))
    path = scratch_folder(spark, "lines")
    cut.write.text(path)
    return path


@query("src_annotations", "label_rows", """select cast(image_id as varchar) as image_id, 'ok' as status,
    array_to_string(present, ',') as present, array_to_string(uncertain, ',') as uncertain
  from label_rows where source <> 'src7'""")
def src_annotations(spark, sf):
    rows, _rejects = readers.src_annotations(spark, _written_lines(spark, sf), schemas.LABEL_ROW)
    return rows.select("image_id", "status", F.array_join("present", ",").alias("present"),
                       F.array_join("uncertain", ",").alias("uncertain"))


@query("src_annotations_rejects", "label_rows", """select substring('{"image_id":"' ||
    cast(image_id as varchar) || '","status":"ok"', 1, 20) as line from label_rows where source = 'src7'""")
def src_annotations_rejects(spark, sf):
    _rows, rejects = readers.src_annotations(spark, _written_lines(spark, sf), schemas.LABEL_ROW)
    return rejects.select("line")


@query("src_id_manifest", "images", """select image_id, row_number() over (order by images.pos) - 1 as place
  from images""")
def src_id_manifest(spark, sf):
    path = scratch_folder(spark, "manifest")
    readers.write_id_manifest(I.images(spark, sf), path)
    return readers.src_id_manifest(spark, path).select("image_id", F.col("pos").alias("place"))


@query("src_dictionary", "tags", ", " + _DICT + """, listed as (select concept_idx as c, name,
      string_agg(member, ',' order by member) as members from dict group by all)
  select row_number() over (order by c) - 1 as concept_idx, name, members from listed""")
def src_dictionary(spark, sf):
    # A dictionary is one small document: its size is the number of concepts.
    entries = _dictionary(spark, sf).agg(F.to_json(F.transform(F.array_sort(F.collect_list(
        F.struct("concept_idx", "name", "members"))), lambda s: F.struct(s["name"].alias("name"),
                                                                         s["members"].alias("members"))))
        .alias("value"))
    path = scratch_folder(spark, "dictionary")
    entries.write.text(path)
    stored = readers.src_dictionary(spark, path)
    contracts.require_empty(readers.dictionary_violations(stored), "dictionary")
    return stored.select(F.col("concept_idx").cast("long"), "name",
                         F.array_join("members", ",").alias("members"))


@query("src_split_manifest", "nation_splits", "select class, split from nation_splits")
def src_split_manifest(spark, sf):
    # A split manifest is one small document: its size is the number of classes.
    document = I.nation_splits(spark, sf).agg(F.to_json(F.struct(
        F.lit("object_class").alias("unit"), F.map_from_entries(F.collect_list(
            F.struct("class", "split"))).alias("classes"))).alias("value"))
    path = scratch_folder(spark, "splits")
    document.write.text(path)
    return readers.src_split_manifest(spark, path, "object_class")


@query("src_embeddings", "vec", """select vec_id, len(e) as dims, round(list_sum(e), 6) as total from vec""")
def src_embeddings(spark, sf):
    return readers.src_embeddings(spark, f"{sf}/embeddings.parquet").select(
        "vec_id", F.size("embedding").cast("long").alias("dims"),
        r6(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x), "total"))


@query("src_profiles", "profile_cells", """select image_id, round(sum(score), 6) as total
  from profile_cells where model = 'standardized' group by image_id""")
def src_profiles(spark, sf):
    path = scratch_folder(spark, "profiles")
    I.profiles(spark, sf).write.partitionBy("model").parquet(path)
    return readers.src_profiles(spark, path, ["standardized"]).select("image_id", r6(
        F.aggregate("profile", F.lit(0.0), lambda t, x: t + x), "total"))


_BLOCK = "'source=' || source || '/block=' || (doc_id // 500)"


def _written_ids(spark, sf):
    """The document ids of each source in text files of 500 ids."""
    path = scratch_folder(spark, "ids")
    docs = I.table(spark, sf, "documents").select(
        "source", F.floor(F.col("doc_id") / 500).alias("block"), "doc_id")
    # Small in bytes but many files: without a fixed number of tasks they would be coalesced into one.
    tasks = 4 * spark.sparkContext.defaultParallelism
    placed = docs.repartition(tasks, "source", "block").sortWithinPartitions("source", "block", "doc_id")
    placed.select("source", "block", F.col("doc_id").cast("string").alias("value")).write.partitionBy(
        "source", "block").text(path)
    return path


def _folder(column: str):
    return F.regexp_extract(column, "(source=[^/]*/block=[0-9]+)/", 1)


@query("list_images", "", f"""select {_BLOCK} as image_id,
    sum(length(cast(doc_id as varchar)) + 1)::bigint as length from documents group by 1""")
def list_images(spark, sf):
    files = readers.list_images(spark, _written_ids(spark, sf), [".txt"])
    return files.select(_folder("image_id").alias("image_id"), "length")


@query("file_checksums", "", f"""select {_BLOCK} as artifact,
    sum(length(cast(doc_id as varchar)) + 1)::bigint as bytes,
    sha256(string_agg(cast(doc_id as varchar), chr(10) order by doc_id) || chr(10)) as sha256
  from documents group by 1""")
def file_checksums(spark, sf):
    sums = readers.file_checksums(spark, _written_ids(spark, sf), parts=3)
    return sums.select(_folder("artifact").alias("artifact"), "bytes", "sha256")


@query("partition_by_split", "tag_rows nation_splits", """select split, count(*) as rows
  from tag_rows join nation_splits using (class) group by split""")
def partition_by_split(spark, sf):
    return sinks.partition_by_split(I.tag_rows(spark, sf).select("image_id", "attributes"),
                                    I.nation_splits(spark, sf), scratch_folder(spark, "by-split"))


_RUN_ROW = T.StructType([
    T.StructField("image_id", T.LongType()), T.StructField("run_id", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("value", T.DoubleType())])


@query("route_ok_error", "runs", "select image_id, run_id, status, value, status as outcome from runs")
def route_ok_error(spark, sf):
    path = scratch_folder(spark, "routed")
    sinks.route_ok_error(I.event_runs(spark, sf).select(*_RUN_ROW.names), path)
    parts = [sinks.read_routed(spark, path, _RUN_ROW, kind).withColumn("outcome", F.lit(kind))
             for kind in ("ok", "error")]
    return parts[0].unionByName(parts[1])


@query("sink_atomic", "shards manifest source_splits", """select m.pos, s.image_id, s.source
  from shards s join manifest m using (image_id) join source_splits using (class) where split = 'train'""")
def sink_atomic(spark, sf):
    train = joins.join_split(I.document_manifest(spark, sf), I.source_splits(spark, sf), "class").where(
        "split = 'train'").select("pos", "image_id")
    rows = I.label_shards(spark, sf).join(train, "image_id").select("pos", "image_id", "source")
    return sinks.sink_atomic(rows, scratch_folder(spark, "merged"))


# ---- hooks -----------------------------------------------------------------

def _fake_annotator(batch, attempt, budget):
    """Answers by prompt: some only succeed later, some are cut short, some never succeed."""
    out = []
    for prompt in batch["prompt"]:
        if prompt.startswith("error"):
            out.append(("bad", False))
        elif prompt.startswith("signup"):
            out.append((f"good {prompt}", budget < 300))
        elif prompt.startswith("click") and attempt < 3:
            out.append(("bad", False))
        else:
            out.append((f"good {prompt}", False))
    return out


@query("annotate", "runs", """select image_id, case when event_type = 'error' then 'error' else 'ok' end
    as status, case when event_type <> 'error' then 'good ' || event_type || ' ' ||
    cast(image_id as varchar) end as content, case event_type when 'error' then 3 when 'click' then 3
    when 'signup' then 2 else 1 end as attempts, case event_type
    when 'error' then 'attempt 1: invalid|attempt 2: invalid|attempt 3: invalid'
    when 'click' then 'attempt 1: invalid|attempt 2: invalid' when 'signup' then 'attempt 1: truncated'
    else '' end as errors from runs""")
def annotate(spark, sf):
    items = I.event_runs(spark, sf).select("image_id", F.concat(
        "event_type", F.lit(" "), F.col("image_id").cast("string")).alias("prompt"))
    done = hooks.annotate(items, _fake_annotator, lambda text: None if text.startswith("good")
                          else "invalid", partitions=8)
    return done.select("image_id", "status", "content", "attempts",
                       F.array_join("errors", "|").alias("errors"))


def _vowel_encoder():
    import numpy as np

    return lambda texts: np.array([[t.count(v) + 1.0 for v in "aeiou"] for t in texts])


@query("encode_column", "", """with counts as (select doc_id, list_transform(['a', 'e', 'i', 'o', 'u'],
      lambda v: length(text) - length(replace(text, v, '')) + 1.0::double) as v from documents)
  select doc_id, unnest(range(5)) as i, round(unnest(v) / sqrt(list_dot_product(v, v)), 6) as value
  from counts""")
def encode_column(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    coded = hooks.encode_column(docs, _vowel_encoder, "text").select("doc_id", F.posexplode("embedding")
                                                                    .alias("i", "v"))
    return coded.select("doc_id", F.col("i").cast("long").alias("i"), r6("v", "value"))


# ---- incremental -----------------------------------------------------------

@query("reject_duplicate_success", "broken_shards", """select image_id from broken_shards
  where status = 'ok' group by image_id having count(*) > 1""")
def reject_duplicate_success(spark, sf):
    batch = I.label_shards(spark, sf, broken=True).select("image_id", "status")
    stored = spark.createDataFrame([], batch.schema)
    return ingest.reject_duplicate_success(batch, stored)[1]


@query("ingest_annotations_stream", "runs", """select 'ok' as folder, image_id from runs where status = 'ok'
  union all select 'errors', image_id from runs where status <> 'ok'
  union all select 'duplicates', image_id from runs where status = 'ok' and run_id = '2024-01-02'""")
def ingest_annotations_stream(spark, sf):
    """Two runs over a growing folder; the second also brings one day for the second time."""
    folder = scratch_folder(spark, "ingest")
    rows = I.event_runs(spark, sf).select(*_RUN_ROW.names)
    early = rows.where("run_id < '2024-01-16'")
    early.write.mode("append").json(f"{folder}/source")

    def run():
        return ingest.ingest_annotations_stream(spark, f"{folder}/source", f"{folder}/target",
                                                f"{folder}/checkpoint", _RUN_ROW)
    run()
    late = rows.where("run_id >= '2024-01-16'").unionByName(
        rows.where("run_id = '2024-01-02' and status = 'ok'"))
    late.write.mode("append").json(f"{folder}/source")
    run()
    parts = [ingest.read_ingested(spark, f"{folder}/target", _RUN_ROW, name).select(
        F.lit(name).alias("folder"), "image_id") for name in ("ok", "errors", "duplicates")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("resume_compatibility", "", """with runs as (select lang, count(*) as rows,
      count(*) filter (n_chars >= 100) as kept from documents group by lang)
  select lang, attempt, attempt = 'first run' or attempt = 'same documents'
      or (attempt = 'without short texts' and kept = rows) as accepted, rows
  from runs, (select unnest(['first run', 'same documents', 'without short texts', 'output without metadata'])
    as attempt)""")
def resume_compatibility(spark, sf):
    """A run per language; its parameters are digests of the documents, so the answers follow the data."""
    folder = scratch_folder(spark, "resume")
    docs = I.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("h"))
    docs.write.partitionBy("lang").parquet(f"{folder}/orphans")
    long = F.when(F.col("n_chars") >= 100, F.xxhash64("doc_id", "h"))
    runs = docs.groupBy("lang").agg(F.bit_xor(F.xxhash64("doc_id", "h")).alias("all"), F.bit_xor(long).alias("kept"),
                                    F.count("*").alias("rows"), F.count(long).alias("n")).collect()
    outcome = []
    for run in runs:
        whole = {"selection": str(run["all"]), "source_image_count": str(run["rows"])}
        kept = {"selection": str(run["kept"]), "source_image_count": str(run["n"])}
        meta, output = f"{folder}/meta-{run['lang']}", f"{folder}/output-{run['lang']}"
        for name, expected, at, to in (
                ("first run", whole, meta, output), ("same documents", whole, meta, output),
                ("without short texts", kept, meta, output),
                ("output without metadata", whole, meta + "-none", f"{folder}/orphans/lang={run['lang']}")):
            try:
                ingest.resume_compatibility(spark, at, to, expected)
                outcome.append((run["lang"], name, True, run["rows"]))
            except contracts.ContractError:
                outcome.append((run["lang"], name, False, run["rows"]))
    return spark.createDataFrame(outcome, "lang string, attempt string, accepted boolean, rows long")
