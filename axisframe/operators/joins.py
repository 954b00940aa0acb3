"""Key joins. Sides are never hinted: Catalyst and AQE broadcast what they measured as small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from axisframe.functions.columns import image_class
from axisframe.session import materialize


def join_split(rows: DataFrame, splits: DataFrame, class_col: str | None = None) -> DataFrame:
    """Every image takes its class's split; an unknown class fails the job."""
    added = class_col or "_class"
    keyed = rows if class_col else rows.withColumn(added, image_class("image_id"))
    lookup = splits.select(F.col("class").alias(added), F.col("split").alias("_split"))
    joined = keyed.join(lookup, added, "left")
    split = F.coalesce("_split", F.raise_error(
        F.concat(F.lit("no split is known for class "), F.col(added))).cast("string"))
    out = joined.withColumn("split", split).drop("_split")
    return out if class_col else out.drop(added)


def filter_split(rows: DataFrame, splits: DataFrame, split: str, *, allow_test: bool = False,
                 class_col: str | None = None) -> DataFrame:
    """Rows of one split, or of all splits; reading test needs an explicit opt-in."""
    if split in {"test", "all"} and not allow_test:
        raise ValueError("rows of the test split are read only with allow_test=True")
    joined = join_split(rows, splits, class_col)
    return joined if split == "all" else joined.where(F.col("split") == split)


def filter_nonempty_tags(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.size("attributes"), F.lit(0)) > 0)


def resume_anti(work: DataFrame, done: DataFrame, *, status: str | None = None,
                field: str | None = None) -> DataFrame:
    """Work items that have no completed row with the wanted status and non-empty field."""
    finished = done
    if status is not None:
        finished = finished.where(F.col("status") == status)
    if field is not None:
        kind = done.schema[field].dataType.typeName()
        filled = F.size(field) > 0 if kind in {"array", "map"} else F.length(field) > 0
        finished = finished.where(F.col(field).isNotNull() & filled)
    return work.join(finished.select("image_id").distinct(), "image_id", "left_anti")


def skip_predecessor_shards(work: DataFrame, shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Work minus the successes of earlier shards, and the success count of each shard.

    ``shards`` is the union of the shard tables with a ``source`` column.
    """
    good = shards.where(F.col("status") == "ok")
    counts = good.groupBy("source").agg(F.count("*").alias("rows"))
    return work.join(good.select("image_id").distinct(), "image_id", "left_anti"), counts


def explicit_id_list(images: DataFrame, wanted: DataFrame, split: str
                     ) -> tuple[DataFrame, DataFrame]:
    """Listed images in list order, and the listed ids that are missing or of another split."""
    known = images.select("image_id", "split")
    joined = wanted.select("pos", "image_id").join(known, "image_id", "left")
    bad = joined.where(F.col("split").isNull() | (F.col("split") != split)).select(
        "pos", "image_id",
        F.when(F.col("split").isNull(), "missing").otherwise("wrong_split").alias("rule"))
    good = joined.where(F.col("split") == split).select("pos", "image_id")
    return good, bad


def _mentions(rows: DataFrame, tags: str, name: str) -> DataFrame:
    if "phrase" in rows.columns:
        return rows.select("image_id", F.col("phrase").alias(name))
    return rows.select("image_id", F.explode(F.array_distinct(tags)).alias(name))


def map_tags_to_concepts(rows: DataFrame, dictionary: DataFrame, *,
                         tags: str = "attributes", flagged: DataFrame | None = None) -> DataFrame:
    """``(image_id, concept_idx, name)``: members become concepts, once per image.

    ``rows`` is ``(image_id, phrase)``, or has a list of phrases in the column ``tags``.
    """
    members = dictionary.select("concept_idx", "name", F.explode("members").alias("phrase"))
    if flagged is not None:
        members = drop_flagged_concepts(members, flagged)
    mentions = _mentions(rows, tags, "phrase")
    return (mentions.join(members, "phrase").select("image_id", "concept_idx", "name")
            .distinct())


def drop_flagged_concepts(concepts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Concepts that are not marked universal or vacuous."""
    return concepts.join(flagged.select("name").distinct(), "name", "left_anti")


def caption_or_default(ids: DataFrame, captions: DataFrame, default: str) -> DataFrame:
    """Each id with its last non-empty caption, or the default text."""
    usable = captions.where(F.length("caption") > 0)
    last = usable.groupBy("image_id").agg(F.max_by("caption", "pos").alias("_caption"))
    return ids.join(last, "image_id", "left").select(
        *ids.columns, F.coalesce("_caption", F.lit(default)).alias("caption"))


def _met(edges: DataFrame, decisions: DataFrame, by: Sequence[str], *columns: str) -> GroupedData:
    """Edges and decisions in one table, grouped by id: unlike a join, a group by id and slice leaves rows
    that are dealt by slice where they are."""
    none = F.lit(0).cast("long")
    return edges.select(*by, *columns, F.lit(True).alias("proposed"), none.alias("decided")).unionByName(
        decisions.select(*by, "equivalent", (none + 1).alias("decided")), allowMissingColumns=True).groupBy(*by)


def accepted_edges(edges: DataFrame, decisions: DataFrame, *, weighted: bool, by: Sequence[str] = ("edge_id",)
                   ) -> DataFrame:
    """``(edge_id, left, right, weight)`` of the edges whose only decision accepts them. Edge ids are unique.

    ``by`` may name a column of both tables besides the id that follows from it, as the slice that both
    are dealt by: then nothing is shuffled.
    """
    weight = F.col("text_cosine") if weighted else F.lit(1.0)
    met = _met(edges.withColumn("weight", weight), decisions, by, "left", "right", "weight").agg(
        *[F.max(c).alias(c) for c in ("left", "right", "weight", "proposed", "equivalent")],
        F.sum("decided").alias("decisions"))
    return met.where(F.col("proposed") & (F.col("decisions") == 1) & F.col("equivalent")).select(
        "edge_id", "left", "right", "weight")


def edge_decision_violations(edges: DataFrame, decisions: DataFrame, candidates: DataFrame,
                             by: Sequence[str] = ("edge_id",)) -> DataFrame:
    """``(edge_id, rule)`` for every breach of the one-decision-per-edge contract; ``by`` as above."""
    # A phrase is far rarer than its edges, so unbound ones are found first and written: with their real
    # size their join leaves the edges where they are.
    both = _met(edges, decisions, by).agg(F.max("proposed").alias("proposed"), F.sum("decided").alias("decisions"))
    wrong = both.where(F.col("proposed").isNull() | (F.col("decisions") != 1)).select(
        "edge_id",
        F.when(F.col("proposed").isNull(), "unknown_edge")
        .when(F.col("decisions") == 0, "undecided").otherwise("decided_twice").alias("rule"))
    used = edges.select(F.explode(F.array("left", "right")).alias("phrase")).distinct()
    lost = materialize(used.join(candidates.select("phrase").distinct(), "phrase", "left_anti"))
    unbound = (edges.select("edge_id", F.explode(F.array("left", "right")).alias("phrase"))
               .join(lost, "phrase", "left_semi")
               .select("edge_id", F.lit("unbound_phrase").alias("rule")).distinct())
    return wrong.unionByName(unbound)


def apply_edge_decisions(edges: DataFrame, decisions: DataFrame, candidates: DataFrame, *,
                         weighted: bool) -> tuple[DataFrame, DataFrame]:
    """Accepted edges with weights, and every breach of the one-decision-per-edge contract."""
    return (accepted_edges(edges, decisions, weighted=weighted),
            edge_decision_violations(edges, decisions, candidates))


def tag_backed_exemplars(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Images whose tags meet a concept's terms, with the matched terms.

    ``rows`` is as in ``map_tags_to_concepts``; ``terms`` is ``(name, term)``; ``has_name`` says that the concept's own name was matched.
    """
    mentions = _mentions(rows, "attributes", "term")
    hits = mentions.join(terms.select("name", "term").distinct(), "term")
    # At most one row per dictionary term meets in a group, so the sets stay small.
    return hits.groupBy("name", "image_id").agg(
        F.sort_array(F.collect_set("term")).alias("matched"),
        F.max(F.col("term") == F.col("name")).alias("has_name"))


def exemplar_coverage(exemplars: DataFrame, dictionary: DataFrame) -> DataFrame:
    """How many concepts have an exemplar, and how many one with their own name."""
    per = exemplars.groupBy("name").agg(F.max("has_name").alias("named"))
    joined = dictionary.select("name").join(per, "name", "left")
    return joined.agg(F.count("*").alias("concepts"),
                      F.sum(F.col("named").isNotNull().cast("long")).alias("covered"),
                      F.sum(F.coalesce("named", F.lit(False)).cast("long")).alias("named"))


def manifest_diff(declared: DataFrame, actual: DataFrame, *,
                  keys: Sequence[str] | None = None,
                  defaults: Mapping[str, str | None] | None = None) -> DataFrame:
    """Null-safe differences of two ``(key, value)`` tables; absent keys take their default."""
    defaults = defaults or {}
    both = (declared.select("key", F.col("value").alias("_a"), F.lit(True).alias("_in_a"))
            .join(actual.select("key", F.col("value").alias("_b"), F.lit(True).alias("_in_b")),
                  "key", "full_outer"))
    if keys is not None:
        both = both.where(F.col("key").isin(*keys))
    default: Column = F.lit(None).cast("string")
    for key, value in defaults.items():
        default = F.when(F.col("key") == key, F.lit(value)).otherwise(default)
    filled = both.select(
        "key",
        F.when(F.col("_in_a"), F.col("_a")).otherwise(default).alias("declared"),
        F.when(F.col("_in_b"), F.col("_b")).otherwise(default).alias("actual"))
    return filled.where(~F.col("declared").eqNullSafe(F.col("actual")))
