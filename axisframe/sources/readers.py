"""Scans of annotation, manifest, dictionary, embedding and profile files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe import schemas
from axisframe.functions.columns import IMAGE_SUFFIXES, as_doubles
from axisframe.operators.ranking import ranked


def src_annotations(spark: SparkSession, path: str | Sequence[str],
                    schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Label, tag or caption JSON lines as (rows, rejects); blank lines are skipped."""
    paths = [path] if isinstance(path, str) else list(path)
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.text(paths).where(F.trim("value") != "")
    parsed = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"),
                          F.from_json("value", with_bad, options).alias("r"))
    good = F.col("r._bad").isNull()
    return (parsed.where(good).select(*[F.col(f"r.{f.name}") for f in schema.fields]),
            parsed.where(~good).select("path", "line"))


def src_id_manifest(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """An ordered JSON list of unique ids as ``(pos, image_id)``; positions are explicit from here on.

    A list with line breaks between its ids is read in splits: the place of an id is its file, the
    start of its split, its line within the split and its place within the line. A line that holds
    anything but brackets and quoted ids, and an id that comes twice, fail the job. For a list whose
    ids are cut over lines otherwise, ``layout="document"`` reads each file as one JSON text.
    """
    if layout == "document":
        files = spark.read.text(path, wholetext=True)
        listed = files.select(F.posexplode(F.from_json("value", "array<string>")).alias("_place", "image_id"),
                              F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_start"),
                              F.lit(0).cast("long").alias("_line"))
    else:
        lines = spark.read.text(path).select(
            F.trim("value").alias("_text"), F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
        bare = F.regexp_replace(F.regexp_replace("_text", r"^\[", ""), r"\s*,?\s*\]?\s*,?$", "")
        ids = F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>", {"mode": "PERMISSIVE"})
        sound = (bare == "") | F.col("_text").rlike(r'^\[?\s*"(?:[^"\\]|\\.)*"(?:\s*,\s*"(?:[^"\\]|\\.)*")*\s*,?\s*\]?$')
        checked = F.when(sound, ids).otherwise(F.raise_error(F.concat(
            F.lit("not a line of quoted ids: "), F.substring("_text", 1, 80))).cast("array<string>"))
        listed = lines.where(F.col("_text") != "").select(
            F.posexplode(checked).alias("_place", "image_id"), "_file", "_start", "_line")
    # Counted beside the ranking, so that a repeated id cannot pass as two positions.
    placed = ranked(listed, ["_file", "_start", "_line", "_place"], name="pos", start=0)
    uses = placed.groupBy("image_id").agg(F.count("*").alias("_uses"), F.min("pos").alias("pos"))
    return uses.select("pos", F.when(F.col("_uses") == 1, F.col("image_id")).otherwise(F.raise_error(
        F.concat(F.lit("an id is listed twice: "), "image_id")).cast("string")).alias("image_id"))


def write_id_manifest(ids: DataFrame, path: str) -> None:
    """One quoted id per line, in ``pos`` order over the part files."""
    quoted = F.regexp_extract(F.to_json(F.array("image_id")), r"^\[(.*)\]$", 1)
    ids.orderBy("pos").select(F.concat(F.lit("  "), quoted, F.lit(",")).alias("value")).write.mode(
        "overwrite").text(path)


def src_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Concept list with members as ``(concept_idx, name, members, prevalence, ...)``."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.posexplode(
        F.from_json("value", T.ArrayType(schemas.DICTIONARY_ENTRY))).alias("concept_idx", "entry"))
    return entries.select("concept_idx", "entry.*")


def dictionary_violations(dictionary: DataFrame) -> DataFrame:
    """Names used twice and members claimed by two concepts, as ``(rule, key, uses)``."""
    names = dictionary.groupBy(F.col("name").alias("key")).agg(F.count("*").alias("uses"))
    members = (dictionary.select("concept_idx", F.explode("members").alias("key")).distinct()
               .groupBy("key").agg(F.count("*").alias("uses")))
    return (names.where("uses > 1").select(F.lit("duplicate_name").alias("rule"), "key", "uses")
            .unionByName(members.where("uses > 1")
                         .select(F.lit("shared_member").alias("rule"), "key", "uses")))


def src_split_manifest(spark: SparkSession, path: str, unit: str) -> DataFrame:
    """``(class, split)``; a manifest of another unit or with an unknown split fails the job."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", schemas.SPLIT_MANIFEST).alias("m")).select("m.*")
    checked = parsed.select(
        F.when(F.col("unit") == unit, F.col("classes")).otherwise(
            F.raise_error(F.lit(f"split manifest must use unit {unit}"))
            .cast("map<string,string>")).alias("classes"))
    rows = checked.select(F.explode("classes").alias("class", "split"))
    return rows.select("class", F.when(F.col("split").isin(*schemas.SPLITS), F.col("split"))
                       .otherwise(F.raise_error(F.concat(F.lit("unknown split "), "split"))
                                  .cast("string")).alias("split"))


def src_embeddings(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    """Embeddings with a DOUBLE vector column: float arrays of one width, at least one row."""
    df = spark.read.parquet(path)
    kind = df.schema[vector].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(
            kind.elementType, (T.FloatType, T.DoubleType)):
        raise ValueError(f"{vector} must be an array of float or double")
    seen = df.agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).head()
    if not seen["n"]:
        raise ValueError("no embeddings were stored")
    if seen["low"] != seen["high"] or seen["low"] <= 0:
        raise ValueError(f"embeddings of {seen['low']} to {seen['high']} dimensions under one name")
    return df.withColumn(vector, as_doubles(vector))


def src_profiles(spark: SparkSession, path: str, models: Sequence[str] = (), expected: DataFrame | None = None
                 ) -> DataFrame:
    """``(model, image_id, profile)`` partitioned by model, so a model filter prunes folders.

    Each model named must be stored; with ``expected`` (``image_id``) each must cover those ids.
    """
    df = spark.read.parquet(path)
    df = df.where(F.col("model").isin(*models)) if models else df
    stored = {r["model"] for r in df.select("model").distinct().collect()}
    if absent := sorted(set(models) - stored):
        raise ValueError(f"no profiles of {', '.join(absent)}")
    if expected is not None:
        for model in sorted(stored):
            uncovered = expected.join(df.where(F.col("model") == model), "image_id", "left_anti")
            if not uncovered.isEmpty():
                raise ValueError(f"profiles of {model} do not cover all ids")
    return df


def list_images(spark: SparkSession, path: str,
                suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Images below a folder by serialized relative path; file contents are never read."""
    root = path.rstrip("/") + "/"
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "length"))
    matched = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))
    relative = F.substring_index(F.col("path"), root, -1)
    return matched.select(relative.alias("image_id"), "length").orderBy("image_id")


def file_checksums(spark: SparkSession, path: str | Sequence[str], parts: int = 1) -> DataFrame:
    """``(artifact, bytes, sha256)`` per file, named by the last ``parts`` parts of its path.

    One file is one task, as its digest demands, and one value there: files end at 2 GB.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths))
    return files.select(F.substring_index("path", "/", -parts).alias("artifact"),
                        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def wide_to_long_scores(wide: DataFrame, prefix: str = "s_",
                        keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``s_<name>`` columns to ``(keys, concept, score)`` in one narrow pass."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.select(*keys, *[F.col(f"`{c}`").alias(c[len(prefix):]) for c in columns])
    return long.unpivot(list(keys), [F.col(f"`{c[len(prefix):]}`") for c in columns],
                        "concept", "score")


def long_to_wide_scores(long: DataFrame, names: Sequence[str], prefix: str = "s_",
                        keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The concept list is given, so the pivot needs no extra pass to find it."""
    wide = long.groupBy(*keys).pivot("concept", list(names)).agg(F.first("score"))
    return wide.select(*keys, *[F.col(f"`{n}`").alias(prefix + n) for n in names])
