"""Registered queries: vectors, similarity, graphs and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisframe.functions import columns as C
from axisframe.operators import graph, linalg, retrieval, sampling, similarity, summaries
from axisframe.plans import inputs as I
from axisframe.plans.registry import query

r6 = I.r6
SCHEDULE = I.SCHEDULE

# ---- rows ------------------------------------------------------------------


@query("l2_normalize", "vec", """select vec_id, i, round(x / greatest(sqrt(n), 1e-8::double), 6) as value
  from (select vec_id, unnest(list_transform(e, lambda x: 3 * x)) as x, unnest(range(len(e))) as i,
    9 * list_dot_product(e, e) as n from vec)""")
def l2_normalize(spark, sf):
    tripled = I.vectors(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: 3 * x))
    unit = linalg.l2_normalize(tripled)
    return unit.select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", F.col("i").cast("long").alias("i"), r6("x", "value"))


@query("embedding_checks", "vec", """select count(*) as rows, max(len(e)) as dimensions,
    min(len(e)) = max(len(e)) as same_dimensions, true as all_finite,
    count(*) filter (n = 0) as zero_norm_rows, round(min(n), 6) as norm_min, round(avg(n), 6) as norm_mean,
    round(max(n), 6) as norm_max, round(max(abs(n - 1)), 6) as max_abs_error,
    round(avg((abs(n - 1) <= 5e-4)::int), 6) as fraction_within_atol
  from (select e, sqrt(list_dot_product(e, e)) as n from vec)""")
def embedding_checks(spark, sf):
    c = linalg.embedding_checks(I.vectors(spark, sf))
    return c.select(*[r6(x) if x.startswith(("norm", "max_abs", "fraction")) else x for x in c.columns])


@query("paired_cosine_summary", "unit_pairs", """select count(*) as pairs, round(avg(c), 6) as mean,
    round(stddev_pop(c), 6) as standard_deviation, round(quantile_cont(c, 0.05), 6) as p05,
    round(quantile_cont(c, 0.5), 6) as median, round(quantile_cont(c, 0.95), 6) as p95
  from (select list_dot_product(image, caption) as c from unit_pairs)""")
def paired_cosine_summary(spark, sf):
    s = linalg.paired_cosine_summary(I.pairs(spark, sf))
    return s.select("pairs", *[r6(c) for c in ("mean", "standard_deviation", "p05", "median", "p95")])


_SCORES = """, scored as (select vec_id as image_id, label, concept_idx, list_dot_product(e, d) as score
    from vec, axes)"""


def _scored(spark, sf):
    rows = I.vectors(spark, sf).select(F.col("vec_id").alias("image_id"), "label", "embedding")
    return linalg.project_scores(rows, I.axis_directions(spark, sf))


@query("project_scores", "vec axes", _SCORES + """
  select image_id, concept_idx, round(score, 6) as score from scored""")
def project_scores(spark, sf):
    return _scored(spark, sf).select("image_id", F.posexplode("scores").alias("concept_idx", "s")).select(
        "image_id", "concept_idx", r6("s", "score"))


@query("column_moments", "vec axes", _SCORES + """
  select concept_idx, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std
  from scored group by concept_idx""")
def column_moments(spark, sf):
    return linalg.column_moments(_scored(spark, sf)).select("concept_idx", r6("mean"), r6("std"))


@query("standardized_profile", "split_vectors axes", """, p as (select image_id, split, concept_idx,
      list_dot_product(e, d) as s from split_vectors, axes),
    m as (select concept_idx, avg(s) as mean, stddev_pop(s) as std from p where split = 'train'
      group by concept_idx)
  select image_id, concept_idx, round((s - mean) / (std + 1e-6::double), 6) as score
  from p join m using (concept_idx) where split <> 'train'""")
def standardized_profile(spark, sf):
    rows = I.split_vectors(spark, sf)
    prof = linalg.standardized_profile(rows.where("split = 'train'"), rows.where("split <> 'train'")
                                       .select("image_id", "embedding"), I.axis_directions(spark, sf))
    return prof.select("image_id", F.posexplode("profile").alias("concept_idx", "s")).select(
        "image_id", "concept_idx", r6("s", "score"))


_CLASS_MEANS = """ select label as class, concept_idx, round(avg(score), 6) as score from scored
  group by all"""


@query("class_mean_profiles", "vec axes", _SCORES + _CLASS_MEANS)
def class_mean_profiles(spark, sf):
    means = linalg.class_mean_profiles(_scored(spark, sf).withColumnRenamed("label", "class"))
    return means.select("class", F.posexplode("scores").alias("concept_idx", "s")).select(
        "class", "concept_idx", r6("s", "score"))


@query("phrase_usage_profiles", "vec axes", _SCORES + _CLASS_MEANS)
def phrase_usage_profiles(spark, sf):
    rows = I.vectors(spark, sf).withColumnRenamed("label", "class")
    return linalg.phrase_usage_profiles(rows, I.axis_directions(spark, sf)).select(
        "class", F.posexplode("scores").alias("concept_idx", "s")).select(
        "class", "concept_idx", r6("s", "score"))


_CORR = """, corr as (select a.concept as i, b.concept as j, corr(a.score, b.score) as r
    from cells a join cells b using (image_id) group by all)"""


@query("correlation_matrix", "cells", _CORR + " select i, j, round(r, 6) as r from corr")
def correlation_matrix(spark, sf):
    return linalg.correlation_matrix(I.vectors(spark, sf), "embedding").select("i", "j", r6("r"))


@query("cosine_matrix", "axes", """select a.concept_idx as "left", b.concept_idx as "right",
  round(list_dot_product(a.d, b.d), 6) as cosine from axes a, axes b""")
def cosine_matrix(spark, sf):
    m = linalg.cosine_matrix(I.axis_directions(spark, sf), "concept_idx", "direction")
    return m.select("left", "right", r6("cosine"))


# ---- edges and graphs ------------------------------------------------------

def _phrase_vectors(spark, sf):
    return I.vectors(spark, sf).select(
        F.format_string("v%06d", "vec_id").alias("phrase"), "embedding", "label")


@query("propose_merge_edges", "edges", """select format('e{:06d}', row_number() over (order by cosine desc,
    l, r) - 1) as edge_id, format('v{:06d}', l) as "left", format('v{:06d}', r) as "right",
    round(cosine, 6) as text_cosine from edges""")
def propose_merge_edges(spark, sf):
    e = similarity.propose_merge_edges(_phrase_vectors(spark, sf), I.EDGE_THRESHOLD)
    return e.select("edge_id", "left", "right", r6("text_cosine"))


_COMPONENTS = """, near as (select l, r from edges where cosine >= 0.5::double),
  both_ways as (select l, r from near union all select r, l from near),
  hops as (select vec_id as node, vec_id as reach from vec union
    select hops.node, b.r from hops join both_ways b on hops.reach = b.l)"""


def _recursive(needs: str, body: str) -> str:
    return I.sql(needs, body).replace("with ", "with recursive ", 1)


@query("connected_components")
def connected_components(spark, sf):
    near = similarity.cosine_edges(I.vectors(spark, sf), 0.5, "vec_id")
    return graph.connected_components(near.select(F.col("left").alias("src"), F.col("right").alias("dst")),
                                      I.vectors(spark, sf).select(F.col("vec_id").alias("node")))


_LEVELS = (0.1, 0.2, 0.3, 0.4)


@query("correlation_graph_stats")
def correlation_graph_stats(spark, sf):
    r = linalg.correlation_matrix(I.vectors(spark, sf), "embedding")
    return similarity.correlation_graph_stats(r, _LEVELS).select(
        "threshold", "edges", r6("density"), "components", "largest_component", "median_degree")


_GRAPH = _CORR + """, lvl as (select unnest([0.1, 0.2, 0.3, 0.4])::double as threshold),
  links as (select threshold, i, j from corr, lvl where i <> j and abs(r) >= threshold),
  hops as (select threshold, i as node, i as reach from corr, lvl where i = j union
    select h.threshold, h.node, l.j from hops h join links l on l.threshold = h.threshold
      and h.reach = l.i),
  comp as (select threshold, node, min(reach) as c from hops group by all),
  sizes as (select threshold, c, count(*) as n from comp group by all),
  degree as (select threshold, node, (select count(*) from links l where l.threshold = comp.threshold
    and l.i = comp.node) as d from comp)
  select s.threshold, e.edges, round(e.edges * 2 / (nodes * (nodes - 1))::double, 6) as density,
    s.components, s.largest_component, e.median_degree
  from (select threshold, count(*) as components, max(n) as largest_component from sizes group by all) s
  join (select threshold, (sum(d) / 2)::bigint as edges, count(*) as nodes,
    quantile_cont(d, 0.5)::double as median_degree from degree group by all) e using (threshold)"""


@query("overlap_by_exemption", "cells", _CORR + """, cov as (select i, j, r, (select
      list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v))
      from (select concept, list(score order by image_id) as v from cells group by concept) x,
      (select concept, list(score order by image_id) as v from cells group by concept) y
      where x.concept = corr.i and y.concept = corr.j) as c from corr where i < j)
  select case when abs(r) < 0.1 then 'penalized' else 'exempt' end as kind, count(*) as pairs,
    round(sqrt(avg(c * c)), 6) as rms, round(quantile_cont(abs(c), 0.5), 6) as median,
    round(quantile_cont(abs(c), 0.9), 6) as p90 from cov group by kind""")
def overlap_by_exemption(spark, sf):
    rows = I.vectors(spark, sf)
    r = linalg.correlation_matrix(rows, "embedding")
    gram = linalg.matrix_sums(rows, ["embedding"], lambda x: {"g": x.T @ x})
    cells = gram.select(F.col("row").alias("i"), F.posexplode("values").alias("j", "v"))
    own = cells.where("i = j").select("i", F.sqrt("v").alias("n"))
    cosine = (cells.join(own, "i").join(own.select(F.col("i").alias("j"), F.col("n").alias("m")), "j")
              .select("i", "j", (F.col("v") / (F.col("n") * F.col("m"))).alias("cosine")))
    out = similarity.overlap_by_exemption(r.join(cosine, ["i", "j"]), 0.1)
    return out.select("kind", "pairs", r6("rms"), r6("median"), r6("p90"))


# ---- paired retrieval ------------------------------------------------------

@query("gallery_scores", "vec", """select query_id, rank::int as rank, item_id, round(score, 6) as score
  from (select *, row_number() over (partition by query_id order by round(score, 12) desc, item_id) as rank
    from (select a.vec_id as query_id, b.vec_id as item_id, list_dot_product(a.e, b.e) as score from vec a, vec b))""")
def gallery_scores(spark, sf):
    v = I.vectors(spark, sf)
    every = retrieval.ranked_gallery(v.select(F.col("vec_id").alias("query_id"), "embedding"),
                                     v.select(F.col("vec_id").alias("item_id"), "embedding"))
    return every.select("query_id", "rank", "item_id", r6("score"))


def _direction_sql(pairs: str, q: str, t: str) -> str:
    return f"""select a.pos, 1 + count(*) filter (b.pos <> a.pos
        and list_dot_product(a.{q}, b.{t}) > list_dot_product(a.{q}, a.{t}) + 1e-12)
      + count(*) filter (b.pos < a.pos and abs(list_dot_product(a.{q}, b.{t})
        - list_dot_product(a.{q}, a.{t})) <= 1e-12) as rank
    from {pairs} a, {pairs} b group by a.pos"""


def _paired_sql(pairs: str) -> str:
    return f"""select 'image_to_caption' as direction, * from ({_direction_sql(pairs, 'image', 'caption')})
    union all select 'caption_to_image', * from ({_direction_sql(pairs, 'caption', 'image')})"""


_SUMMARY = """count(*) as queries, avg((rank <= 1)::int) as recall_at_1,
    avg((rank <= 5)::int) as recall_at_5, avg((rank <= 10)::int) as recall_at_10,
    round(avg(1.0 / rank), 6) as mean_reciprocal_rank, round(avg(rank), 6) as mean_rank,
    max(rank) as maximum_rank, quantile_cont(rank, 0.5)::double as median_rank"""


@query("target_rank_index_tie", "unit_pairs", _direction_sql("unit_pairs", "image", "caption"))
def target_rank_index_tie(spark, sf):
    return retrieval.target_rank_index_tie(I.pairs(spark, sf), "image", "caption")


@query("paired_retrieval", "unit_pairs", f"""select direction, {_SUMMARY}
  from ({_paired_sql("unit_pairs")}) group by direction""")
def paired_retrieval(spark, sf):
    m = retrieval.paired_retrieval(I.pairs(spark, sf))
    return m.select("direction", "queries", "recall_at_1", "recall_at_5", "recall_at_10",
                    r6("mean_reciprocal_rank"), r6("mean_rank"), "maximum_rank",
                    F.col("median_rank").cast("double"))


@query("quality_gates", "pairs unit_pairs narrow_pairs", f""", wide as (select direction, {_SUMMARY}
      from ({_paired_sql("unit_pairs")}) group by direction),
    narrow as (select direction, {_SUMMARY} from ({_paired_sql("narrow_pairs")}) group by direction),
    drops as (select direction || '.recall_at_' || k as gate, 100 * (c - b) as value,
      100 * (c - b) >= -1 as passed from (
        select w.direction, unnest(['1', '5', '10']) as k,
          unnest([w.recall_at_1, w.recall_at_5, w.recall_at_10]) as b,
          unnest([n.recall_at_1, n.recall_at_5, n.recall_at_10]) as c
        from wide w join narrow n using (direction))),
    norms as (select 'normalization.' || label as gate, max(abs(n - 1)) as value,
      max(abs(n - 1)) <= 5e-4 as passed from (
        select 'baseline_image' as label, sqrt(list_dot_product(image, image)) as n from pairs
        union all select 'baseline_caption', sqrt(list_dot_product(caption, caption)) from pairs
        union all select 'candidate_image', sqrt(list_sum(list_transform(range(1, 64, 2), lambda j: (image[j] + image[j + 1]) ** 2))) from pairs
        union all select 'candidate_caption', sqrt(list_sum(list_transform(range(1, 64, 2), lambda j: (caption[j] + caption[j + 1]) ** 2)))
          from pairs) group by label),
    every_gate as (select * from norms union all select * from drops)
  select gate, round(value, 6) as value, passed from every_gate union all
  select 'overall', round((select min(value) from drops), 6), bool_and(passed) from every_gate""")
def quality_gates(spark, sf):
    wide, narrow = I.pairs(spark, sf), I.narrow_pairs(spark, sf)
    checks, metrics = None, None
    for name, frame in (("baseline", wide), ("candidate", narrow)):
        for role in ("image", "caption"):
            one = linalg.embedding_checks(frame, role).select(
                F.lit(f"{name}_{role}").alias("label"), "all_finite", "zero_norm_rows", "max_abs_error")
            checks = one if checks is None else checks.unionByName(one)
        # The gates need recall only.
        part = retrieval.paired_ranks(frame).groupBy("direction").agg(*[
            F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_at_{k}") for k in (1, 5, 10)]
        ).withColumn("encoder", F.lit(name))
        metrics = part if metrics is None else metrics.unionByName(part)
    return retrieval.quality_gates(checks, metrics, 5e-4, 1.0).select("gate", r6("value"), "passed")


# ---- compositional retrieval -----------------------------------------------

def _rollouts(spark, sf):
    # Among many vectors some are positive nearly everywhere: their random sequences are short, as in SQL.
    return sampling.concept_rollouts(I.concept_sets(spark, sf), I.N_DIMS, SCHEDULE, I.ROLLOUT_SEED, short_draws=True)


@query("concept_rollouts", "rollouts", """select image_id, rollout, kind, step, concept from rollouts""")
def concept_rollouts(spark, sf):
    return _rollouts(spark, sf).select("image_id", "rollout", "kind",
                                       F.posexplode("seq").alias("p", "concept")).select(
        "image_id", "rollout", "kind", (F.col("p") + 1).cast("long").alias("step"), "concept")


@query("rollout_counts", "rollouts sizes", """select size, count(distinct image_id) as images,
    count(*) as queries from (select distinct image_id, rollout, size from rollouts, sizes
      where kind = 'true' and rollout < allowed and step = size) group by size""")
def rollout_counts(spark, sf):
    return sampling.rollout_counts(_rollouts(spark, sf), SCHEDULE)


@query("nested_prefix_scores", "rollouts profile_cells", """select model, image_id, rollout, kind, step,
    round(sum(score) over (partition by model, image_id, rollout, kind order by step), 6) as score
  from rollouts join profile_cells using (image_id, concept)""")
def nested_prefix_scores(spark, sf):
    s = retrieval.nested_prefix_scores(_rollouts(spark, sf), I.profiles(spark, sf))
    return s.select("model", "image_id", "rollout", "kind", F.col("step").cast("long"), r6("score"))


def _ranks(spark, sf):
    return retrieval.compositional_ranks(I.concept_sets(spark, sf), I.profiles(spark, sf), I.N_DIMS,
                                         SCHEDULE, I.ROLLOUT_SEED, short_draws=True)


@query("target_rank_avg_tie", "ranks", """select model, image_id, rollout, kind, size,
  rank::double as rank from ranks""")
def target_rank_avg_tie(spark, sf):
    ranks = retrieval.target_rank_avg_tie(_rollouts(spark, sf), I.profiles(spark, sf), SCHEDULE)
    return ranks.select("model", "image_id", "rollout", "kind", "size", F.col("rank").cast("double"))


@query("compositional_ranks", "ranks", """select model, image_id, rollout, kind, size,
  rank::double as rank from ranks""")
def compositional_ranks(spark, sf):
    return _ranks(spark, sf).select("model", "image_id", "rollout", "kind", "size",
                                    F.col("rank").cast("double"))


_GALLERY = "(select count(*) from vec)"


@query("recall_curve", "ranks", f"""select model, kind, size, count(distinct image_id) as images,
    count(*) as queries, {", ".join(f"round(avg((rank <= {k})::int), 6) as recall_at_{k}"
                                    for k in retrieval.RECALL_AT)},
    round(avg(1.0 / rank), 6) as mean_reciprocal_rank, quantile_cont(rank::double, 0.5) as median_rank,
    round(avg((rank - 1) / ({_GALLERY} - 1)::double), 6) as mean_normalized_rank,
    {", ".join(f"round({k} / {_GALLERY}::double, 6) as chance_at_{k}" for k in retrieval.RECALL_AT)}
  from ranks group by all""")
def recall_curve(spark, sf):
    c = retrieval.recall_curve(_ranks(spark, sf), I.vectors(spark, sf).count())
    keep = ("model", "kind", "size", "images", "queries", "median_rank")
    return c.select(*[F.col(x).cast("double") if x == "median_rank" else x if x in keep else r6(x)
                      for x in c.columns])


@query("rank_change_by_length", "ranks", """, steps as (select model, kind, size as to_size,
      lag(size) over w as from_size, (rank - lag(rank) over w)::double as change from ranks
    window w as (partition by model, kind, image_id, rollout order by size))
  select model, kind, from_size, to_size, count(*) as n, round(avg((change < 0)::int), 6) as improved,
    round(avg((change = 0)::int), 6) as unchanged, round(avg((change > 0)::int), 6) as worsened,
    round(avg(change), 6) as mean_rank_change from steps where from_size is not null group by all""")
def rank_change_by_length(spark, sf):
    c = retrieval.rank_change_by_length(_ranks(spark, sf), list(SCHEDULE))
    return c.select("model", "kind", "from_size", "to_size", "n", r6("improved"), r6("unchanged"),
                    r6("worsened"), r6("mean_rank_change"))


@query("paired_comparison", "ranks", """select o.model, o.size, count(*) as n,
    round(avg((r.rank < o.rank)::int), 6) as reference_better,
    round(avg((r.rank = o.rank)::int), 6) as same_rank,
    round(avg((r.rank > o.rank)::int), 6) as reference_worse,
    round(avg((r.rank - o.rank)::double), 6) as mean_rank_difference
  from ranks o join ranks r using (image_id, rollout, kind, size)
  where kind = 'true' and o.model <> 'standardized' and r.model = 'standardized' group by all""")
def paired_comparison(spark, sf):
    c = retrieval.paired_comparison(_ranks(spark, sf), "standardized")
    return c.select("model", "size", "n", r6("reference_better"), r6("same_rank"), r6("reference_worse"),
                    r6("mean_rank_difference"))


@query("cohort_sizes", "ranks",
       "select size, count(distinct image_id) as images from ranks group by size")
def cohort_sizes(spark, sf):
    """A query of a size has a rank if its image has a profile, so the ranks themselves are not made."""
    queries = sampling.with_sizes(_rollouts(spark, sf), SCHEDULE).join(I.profiles(spark, sf), "image_id", "left_semi")
    return summaries.cohort_sizes(queries)


def _standardized(spark, sf):
    return I.profiles(spark, sf).where("model = 'standardized'")


@query("additive_query_topk", "profile_cells", """select image_id, round(sum(score * case concept when 3
    then 1.0 when 10 then 3.0 when 21 then 0.5 else 0 end), 6) as score from profile_cells
  where model = 'standardized' group by image_id order by sum(score * case concept when 3 then 1.0
    when 10 then 3.0 when 21 then 0.5 else 0 end) desc, image_id limit 28""")
def additive_query_topk(spark, sf):
    top = retrieval.additive_query_topk(_standardized(spark, sf), {3: 1.0, 10: 9.0, 21: 0.5, 30: -2.0})
    return top.select("image_id", r6("score"))


@query("load_item_as_query", "profile_cells", """, w as (select concept, greatest(0, least(3, score)) as w
    from profile_cells where model = 'standardized' and image_id = (select min(vec_id) from vec))
  select image_id, round(sum(score * w), 6) as score from profile_cells join w using (concept)
  where model = 'standardized' group by image_id order by sum(score * w) desc, image_id limit 28""")
def load_item_as_query(spark, sf):
    first = I.vectors(spark, sf).agg(F.min("vec_id").alias("v")).head()["v"]
    return retrieval.load_item_as_query(_standardized(spark, sf), first).select("image_id", r6("score"))


@query("top_concepts_per_image", "profile_cells cells", """select image_id, place, concept as concept_idx,
    round(score, 6) as score from (select p.image_id, p.concept, p.score, row_number() over (
      partition by p.image_id order by p.score desc, p.concept) as place
    from profile_cells p join cells c on c.image_id = p.image_id and c.concept = p.concept
    where p.model = 'standardized' and c.score > 0) where place <= 3""")
def top_concepts_per_image(spark, sf):
    top = retrieval.top_concepts_per_image(_standardized(spark, sf), I.concept_sets(spark, sf))
    return top.select("image_id", "place", "concept_idx", r6("score"))


def _register_recursive() -> None:
    from axisframe.plans.registry import ORACLES

    ORACLES["connected_components"] = _recursive(
        "edges", _COMPONENTS + " select node, min(reach) as component from hops group by node")
    ORACLES["correlation_graph_stats"] = _recursive("cells", _GRAPH)


_register_recursive()
