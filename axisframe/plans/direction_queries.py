"""Registered queries: directions, soft labels, summaries and the dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisframe.functions import columns as C
from axisframe.operators import (
    clustering, directions, joins, labels, linalg, retrieval, selection, similarity, softlabels,
    summaries, support)
from axisframe.operators.scalars import with_row
from axisframe.plans import inputs as I
from axisframe.plans.registry import query
from axisframe.session import materialize

r6 = I.r6
NAMES = I.LABEL_NAMES

# ---- directions ------------------------------------------------------------

_MEANS = """, expanded as (select image_id, concept_idx, s, unnest(e) as x, unnest(range(len(e))) as k
      from labelled),
  means as (select concept_idx, k, sum(s * x) / greatest(sum(s), 1e-6::double) as p,
      sum((1 - s) * x) / greatest(sum(1 - s), 1e-6::double) as q, sum(s) as wp, sum(1 - s) as wn
    from expanded group by all),
  dirs as (select concept_idx, k, (p - q) / greatest(sqrt(sum((p - q) * (p - q)) over (
      partition by concept_idx)), 1e-6::double) as d from means)"""


def _cells(df, *columns):
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return df.select("concept_idx", F.posexplode(zipped).alias("k", "c")).select(
        "concept_idx", F.col("k").cast("long").alias("k"), *[r6(f"c.{c}", c) for c in columns])


@query("weighted_group_means", "labelled", _MEANS + """ select concept_idx, k, round(p, 6) as mean_pos,
  round(q, 6) as mean_neg from means""")
def weighted_group_means(spark, sf):
    return _cells(directions.weighted_group_means(I.labelled_vectors(spark, sf)), "mean_pos", "mean_neg")


@query("group_mean_directions", "labelled", _MEANS + """
  select concept_idx, k, round(d, 6) as direction from dirs""")
def group_mean_directions(spark, sf):
    return _cells(directions.group_mean_directions(I.labelled_vectors(spark, sf)), "direction")


# Text directions: a label's members are its vectors, the base is the mean of all vectors.
@query("concept_text_directions", "vec", """, x as (select label, vec_id, unnest(e) as x,
      unnest(range(len(e))) as k from vec),
  delta as (select label, k, avg(x) - (select avg(y.x) from x y where y.k = x.k) as d from x
    group by label, k)
  select label as concept_idx, k, round(d / (sqrt(sum(d * d) over (partition by label)) + 1e-8::double), 6)
    as direction from delta""")
def concept_text_directions(spark, sf):
    v = I.vectors(spark, sf).withColumn("phrase", F.format_string("v%06d", "vec_id"))
    dictionary = v.select(F.col("label").alias("concept_idx"), F.array("phrase").alias("members"))
    base = linalg.vector_mean(v, [], "embedding").head()["embedding"]
    return _cells(directions.concept_text_directions(dictionary, v, base), "direction")


_AUROC = _MEANS + """, proj as (select l.image_id, l.concept_idx, l.s >= 0.5 as hard, v from labelled l
    join (select e.image_id, e.concept_idx, sum(e.x * d.d) as v from expanded e join dirs d
      using (concept_idx, k) group by all) using (image_id, concept_idx)),
  placed as (select *, rank() over (partition by concept_idx order by v)
      + (count(*) over (partition by concept_idx, v) - 1) / 2.0::double as r from proj),
  auc as (select concept_idx, count(*) filter (hard) as positives, count(*) filter (not hard) as negatives,
    (sum(r) filter (hard) - count(*) filter (hard) * (count(*) filter (hard) + 1) / 2.0::double)
      / (count(*) filter (hard) * count(*) filter (not hard)) as auroc from placed group by concept_idx)"""


@query("concept_auroc", "labelled", _AUROC + """ select concept_idx, positives, negatives,
  round(auroc, 6) as auroc from auc where positives > 0 and negatives > 0""")
def concept_auroc(spark, sf):
    rows = I.labelled_vectors(spark, sf)
    scored = linalg.project_scores(rows.select("image_id", "embedding", F.col("scores").alias("soft")),
                                   directions.group_mean_directions(rows))
    cells = scored.select(F.posexplode(F.arrays_zip("scores", "soft")).alias("concept_idx", "c")).select(
        "concept_idx", F.col("c.scores").alias("value"), (F.col("c.soft") >= 0.5).alias("positive"))
    return directions.concept_auroc(cells).select("concept_idx", "positives", "negatives", r6("auroc"))


_GRAM = ", gram as (select a.concept_idx as i, b.concept_idx as j, list_dot_product(a.d, b.d) as cosine " \
        "from axes a, axes b)"


@query("orthogonality_metrics", "axes", _GRAM + """ select (select count(*) from axes) as concepts,
    round(avg(cosine * cosine), 6) as orth, round(sqrt(avg(cosine * cosine)), 6) as orth_rms
  from gram where i <> j""")
def orthogonality_metrics(spark, sf):
    return directions.orthogonality_metrics(I.axis_directions(spark, sf)).select(
        "concepts", r6("orth"), r6("orth_rms"))


_SOFT_CORR = """, corr as (select a.concept_idx as i, b.concept_idx as j, corr(a.s, b.s) as r
    from labelled a join labelled b using (image_id) group by all)"""


def _label_correlations(spark, sf):
    return linalg.correlation_matrix(I.labelled_vectors(spark, sf))


@query("pair_weights", "labelled", _SOFT_CORR + """ select 'hard' as mode, i, j,
    (abs(r) < 0.15)::int::double as weight from corr where i <> j union all
  select 'smooth', i, j, round(0.1 + 0.9 * exp(-pow(abs(r) / 0.15, 2)), 6) from corr where i <> j""")
def pair_weights(spark, sf):
    r = _label_correlations(spark, sf)
    hard = directions.pair_weights(r, "hard", 0.15).withColumn("mode", F.lit("hard"))
    smooth = directions.pair_weights(r, "smooth", 0.15, 0.1, 2.0).withColumn("mode", F.lit("smooth"))
    return hard.unionByName(smooth).select("mode", "i", "j", r6("weight"))


@query("weighted_orthogonality", "labelled", _MEANS + _SOFT_CORR + """, cosines as (
    select a.concept_idx as i, b.concept_idx as j, sum(a.d * b.d) as c from dirs a join dirs b using (k)
    group by all), weights as (select i, j, 0.1 + 0.9 * exp(-pow(abs(r) / 0.15, 2)) as w from corr)
  select count(*) as pairs, round(sum(w), 6) as weight,
    round(sum(w * c * c) / greatest(sum(w), 1e-6), 6) as orth
  from cosines join weights using (i, j) where i <> j""")
def weighted_orthogonality(spark, sf):
    rows = I.labelled_vectors(spark, sf)
    cosines = linalg.cosine_matrix(directions.group_mean_directions(rows), "concept_idx",
                                   "direction").toDF("i", "j", "cosine")
    weights = directions.pair_weights(linalg.correlation_matrix(rows), "smooth", 0.15, 0.1, 2.0)
    return directions.weighted_orthogonality(cosines, weights).select("pairs", r6("weight"), r6("orth"))


@query("contrastive_loss", "unit_pairs", """, logits as (select a.pos // 128 as batch, a.pos as i,
      b.pos as j, 20 * list_dot_product(a.image, b.caption) as z from unit_pairs a join unit_pairs b
      on a.pos // 128 = b.pos // 128),
  by_row as (select batch, i, max(z) + ln(sum(exp(z - m))) as l from (select *, max(z) over (
      partition by batch, i) as m from logits) group by batch, i),
  by_col as (select batch, j, max(z) + ln(sum(exp(z - m))) as l from (select *, max(z) over (
      partition by batch, j) as m from logits) group by batch, j),
  own as (select batch, count(*) as rows, avg(z) as z from logits where i = j group by batch)
  select batch, rows, round(0.5 * ((select avg(l) from by_row r where r.batch = own.batch) - z
    + (select avg(l) from by_col c where c.batch = own.batch) - z), 6) as loss from own""")
def contrastive_loss(spark, sf):
    p = I.pairs(spark, sf).withColumn("image", C.l2_normalize("image")).withColumn(
        "caption", C.l2_normalize("caption"))
    return directions.contrastive_loss(p, 20.0, 128).select("batch", "rows", r6("loss"))


@query("batch_ema_means", "labelled", """, expanded as (select image_id // 64 as batch, concept_idx, s,
      unnest(e) as x, unnest(range(len(e))) as k from labelled),
  means as (select batch, concept_idx, k, sum(s) as wp, sum(1 - s) as wn,
      sum(s * x) / greatest(sum(s), 1e-6::double) as p,
      sum((1 - s) * x) / greatest(sum(1 - s), 1e-6::double) as q from expanded group by all),
  placed as (select *, row_number() over (partition by concept_idx, k order by batch desc) - 1 as later,
      count(*) over (partition by concept_idx, k) as updates from means where wp > 1e-3 and wn > 1e-3),
  weighted as (select *, pow(0.9::double, later) * case when later = updates - 1 then 1.0::double
      else 0.1::double end as w from placed)
  select concept_idx, k, max(updates) as updates, round(sum(w * p), 6) as mean_pos,
    round(sum(w * q), 6) as mean_neg from weighted group by concept_idx, k""")
def batch_ema_means(spark, sf):
    e = directions.batch_ema_means(I.labelled_vectors(spark, sf), 64)
    return e.select("concept_idx", "updates", F.posexplode(F.arrays_zip("mean_pos", "mean_neg"))
                    .alias("k", "c")).select("concept_idx", "updates", F.col("k").cast("long").alias("k"),
                                             r6("c.mean_pos", "mean_pos"), r6("c.mean_neg", "mean_neg"))


@query("caption_retrieval_eval", "labelled unit_pairs", _AUROC + """, own as (
    select a.pos, 1 + count(*) filter (b.pos <> a.pos and list_dot_product(a.image, b.caption)
        > list_dot_product(a.image, a.caption) + 1e-12) + count(*) filter (b.pos < a.pos
        and abs(list_dot_product(a.image, b.caption) - list_dot_product(a.image, a.caption)) <= 1e-12)
      as rank from unit_pairs a, unit_pairs b where a.pos in (select image_id from labelled)
        and b.pos in (select image_id from labelled) group by a.pos),
  cosines as (select a.concept_idx as i, b.concept_idx as j, sum(a.d * b.d) as c from dirs a
    join dirs b using (k) group by all)
  select avg((rank <= 1)::int) as recall_at_1, avg((rank <= 5)::int) as recall_at_5,
    avg((rank <= 10)::int) as recall_at_10,
    (select round(avg(auroc), 6) from auc where positives > 0 and negatives > 0) as auroc,
    (select round(sqrt(avg(c * c)), 6) from cosines where i <> j) as group_mean_orth_rms from own""")
def caption_retrieval_eval(spark, sf):
    rows = I.labelled_vectors(spark, sf).select("pos", "scores")
    both = I.pairs(spark, sf).join(rows, "pos")
    out = retrieval.caption_retrieval_eval(both.select("pos", "image", "caption"),
                                           both.select("pos", "image", "scores"))
    return out.select("recall_at_1", "recall_at_5", "recall_at_10", r6("auroc"), r6("group_mean_orth_rms"))


def _indexed(spark, sf):
    return labels.to_indexes(I.labelled_vectors(spark, sf), NAMES)


def _ridge(rows: str, most: float) -> str:
    """The ridge by elimination on the concept x concept system; ``sol`` holds its rows beside the effects."""
    c = len(NAMES)
    return f""", k as materialized (select l.* from labelled l join (select image_id from labelled group by image_id
      having count(*) filter (state = 'uncertain') <= {most} * {c} + 1e-9) using (image_id) {rows}),
    nn as (select count(distinct image_id)::double as n from k),
    z as materialized (select image_id, unnest(e) as x, unnest(range(len(e))) as d
      from k where concept_idx = 0),
    zm as (select d, avg(x) as m from z group by d),
    scale as (select sqrt(avg(pow(x - m, 2))) as rms from z join zm using (d)),
    p as materialized (select concept_idx, count(*) filter (state = 'present') as positives,
        count(*) filter (state = 'no') as negatives, count(*) filter (state = 'present')::double
          / greatest(count(*) filter (state <> 'uncertain'), 1) as p from k group by concept_idx),
    b as materialized (select image_id, concept_idx, p, case state when 'present' then 1 when 'uncertain' then p else 0 end as b
      from k join p using (concept_idx)),
    left_side as (select i, list(v order by j) as a from (select x.concept_idx as i, y.concept_idx as j,
        sum(x.b * y.b) / any_value(n) - any_value(x.p * y.p)
          + any_value(case when x.concept_idx = y.concept_idx then 1e-3::double else 0 end) as v
      from b x join b y using (image_id), nn group by all) group by i),
    right_side as (select concept_idx as i, list(v order by d) as c from (select concept_idx, d,
        (sum(b * x) / any_value(n) - any_value(p * m)) / any_value(rms) as v
      from b join z using (image_id) join zm using (d), nn, scale group by all) group by i),
    sol as (select 1 as step, list(list_concat(a, c) order by i) as m from left_side join right_side using (i)
      union all select step + 1, list_transform(m, lambda r, i: case when i = step
          then list_transform(r, lambda x: x / r[step])
          else list_transform(r, lambda x, j: x - r[step] * m[step][j] / m[step][step]) end) from sol where step <= {c}),
    eff as materialized (select i::int as concept_idx, m[i + 1][{c + 1}:] as effect
      from sol, (select unnest(range({c})) as i) where step = {c + 1}),
    found as materialized (select concept_idx, effect, sqrt(list_dot_product(effect, effect)) as effect_norm,
        list_transform(effect, lambda x: x / greatest(sqrt(list_dot_product(effect, effect)), 1e-6::double)) as direction,
        positives, negatives, positives >= 1 and negatives >= 1 and sqrt(list_dot_product(effect, effect)) > 1e-6 as supported
      from eff join p using (concept_idx))"""


_RIDGE_SUMMARY = """,
    guess as (select image_id, d, sum((b - p) * effect[d + 1]) as g from b join found using (concept_idx),
      (select unnest(range(64)) as d) group by all),
    errors as (select avg(pow(g - (x - m) / rms, 2)) as fit, avg(pow((x - m) / rms, 2)) as ms
      from guess join z using (image_id, d) join zm using (d), scale),
    pen as (select 1e-3::double * sum(list_dot_product(effect, effect)) / 64 as penalty from found),
    orth as (select coalesce(avg(pow(list_dot_product(x.direction, y.direction), 2)), 0) as o from found x join found y
      on x.concept_idx <> y.concept_idx and x.supported and y.supported)
  select unnest(['kept_rows', 'fit_mse', 'ridge_penalty', 'reconstruction', 'explained_fraction', 'orth', 'orth_rms']) as metric,
    round(unnest([n, fit, penalty, fit + penalty, 1 - fit / ms, o, sqrt(o)]), 6) as value from nn, errors, pen, orth"""


@query("reverse_ridge", "labelled", _ridge("", 0.5) + """
  select concept_idx, o, round(effect[o + 1], 6) as effect, round(direction[o + 1], 6) as direction,
    round(effect_norm, 6) as effect_norm, positives, negatives, supported from found, (select unnest(range(64))::int as o)""")
def reverse_ridge(spark, sf):
    fit = directions.reverse_ridge(_indexed(spark, sf), 1e-3, len(NAMES), max_uncertain=0.5)
    return fit.effects.select("concept_idx", "effect_norm", "positives", "negatives", "supported", F.posexplode(
        F.arrays_zip("effect", "direction")).alias("o", "x")).select(
        "concept_idx", "o", r6("x.effect", "effect"), r6("x.direction", "direction"), r6("effect_norm"), "positives",
        "negatives", "supported")


@query("reverse_ridge_summary", "labelled", _ridge("", 0.25) + _RIDGE_SUMMARY)
def reverse_ridge_summary(spark, sf):
    fit = directions.reverse_ridge(_indexed(spark, sf), 1e-3, len(NAMES))
    return spark.createDataFrame(sorted(fit.summary.items()), "metric string, value double").select("metric", r6("value"))


@query("reverse_ridge_profile", "labelled split_vectors", _ridge(
    "join (select image_id from split_vectors where split = 'train') using (image_id)", 0.5) + """,
    dots as materialized (select image_id, concept_idx, list_dot_product(e, direction) as s from split_vectors, found),
    units as (select concept_idx, avg(s) as mean, stddev_pop(s) as std from dots where image_id in
      (select image_id from split_vectors join labelled using (image_id) where split = 'train') group by concept_idx)
  select image_id, concept_idx, round((s - mean) / (std + 1e-6::double), 6) as score from dots join units using (concept_idx)""")
def reverse_ridge_profile(spark, sf):
    rows = I.split_vectors(spark, sf)
    train = rows.where("split = 'train'").join(_indexed(spark, sf).select(
        "image_id", "present_idx", "uncertain_idx"), "image_id")
    fit = directions.reverse_ridge(train, 1e-3, len(NAMES), max_uncertain=0.5)
    profile = linalg.standardized_profile(train, rows.select("image_id", "embedding"), fit.effects)
    return profile.select("image_id", F.posexplode("profile").alias("concept_idx", "s")).select(
        "image_id", "concept_idx", r6("s", "score"))


@query("concept_support_mask", "labelled", _ridge("", 0.5) + """
  select concept_idx, positives, negatives, round(effect_norm, 6) as effect_norm,
    positives >= 20 and negatives >= 20 and effect_norm > 0.3 as supported from found""")
def concept_support_mask(spark, sf):
    """Enough labels of both kinds, and an effect of the ridge that is not near zero."""
    fit = directions.reverse_ridge(_indexed(spark, sf), 1e-3, len(NAMES), max_uncertain=0.5)
    stats = fit.effects.select("concept_idx", "positives", "negatives", "effect_norm")
    return directions.concept_support_mask(stats, 20, 0.3).select(
        "concept_idx", "positives", "negatives", r6("effect_norm"), "supported")


_PART = "w{0} / sqrt(v{0}) * exp(-0.5 * pow(x - m{0}, 2) / v{0})"

# Expectation and maximization, a step a row; the start is the best cut of the sorted scores.
_MIXTURES = f""", scored as materialized (select image_id, split, concept_idx, list_dot_product(e, d) as x from split_vectors, axes),
    train as materialized (select concept_idx, x from scored where split = 'train'),
    cuts as (select concept_idx, x, count(*) over lo as n0, sum(x) over lo as s0, count(*) over (partition by concept_idx) as n,
        sum(x) over (partition by concept_idx) as s from train window lo as (partition by concept_idx order by x)),
    cut as (select concept_idx, arg_max(x, {{'g': pow(s0 - n0 * s / n, 2) / n0 / (n - n0), 'x': -x}}) as c
      from cuts where n0 < n group by concept_idx),
    start as (select concept_idx, avg((x <= c)::int) as w0, avg((x > c)::int) as w1,
        avg(x) filter (x <= c) as m0, avg(x) filter (x > c) as m1,
        var_pop(x) filter (x <= c) + 1e-6::double as v0, var_pop(x) filter (x > c) + 1e-6::double as v1
      from train join cut using (concept_idx) group by concept_idx),
    em as (select 0 as step, concept_idx, w0, w1, m0, m1, v0, v1, -1e300::double as level, true as moving from start union all
      select step + 1, concept_idx, n0 / (n0 + n1), n1 / (n0 + n1), m0 + a0 / n0, m1 + a1 / n1,
        greatest(q0 / n0 - pow(a0 / n0, 2), 0) + 1e-6::double, greatest(q1 / n1 - pow(a1 / n1, 2), 0) + 1e-6::double,
        now, abs(now - level) >= 1e-3
      from (select step, concept_idx, any_value(m0) as m0, any_value(m1) as m1, any_value(level) as level,
          sum(r) + 10 * 2.220446049250313e-16::double as n0, sum(1 - r) + 10 * 2.220446049250313e-16::double as n1,
          sum(r * (x - m0)) as a0, sum((1 - r) * (x - m1)) as a1,
          sum(r * pow(x - m0, 2)) as q0, sum((1 - r) * pow(x - m1, 2)) as q1, avg(ln(p0 + p1) - 0.5 * ln(2 * pi())) as now
        from (select *, p0 / (p0 + p1) as r from (select *, {_PART.format(0)} as p0, {_PART.format(1)} as p1
          from em join train using (concept_idx) where moving and step < 100)) group by step, concept_idx)),
    final as (select concept_idx, arg_max({{'w0': w0, 'w1': w1, 'm0': m0, 'm1': m1, 'v0': v0, 'v1': v1}}, step) as f
      from em group by concept_idx),
    spread as (select image_id, split, concept_idx, x, f.w0 as w0, f.w1 as w1, f.m0 as m0, f.m1 as m1, f.v0 as v0, f.v1 as v1
      from scored join final using (concept_idx))
  select image_id, split, concept_idx, round(case when m1 > m0 then p1 else p0 end / (p0 + p1), 6) as soft
  from (select *, {_PART.format(0)} as p0, {_PART.format(1)} as p1 from spread)"""


@query("fit_soft_labels", "split_vectors axes", _MIXTURES)
def fit_soft_labels(spark, sf):
    rows = I.split_vectors(spark, sf)
    scored = linalg.project_scores(rows, I.axis_directions(spark, sf))
    return softlabels.fit_soft_labels(scored.where("split = 'train'"), scored).select(
        "image_id", "split", F.posexplode("soft").alias("concept_idx", "s")).select(
        "image_id", "split", "concept_idx", r6("s", "soft"))


# Squaring the class x class Gram matrix time and again leaves the leading direction's projector.
@query("standardize_debias", "vec", """, means as (select label as class, k, avg(x) as x from (select label, unnest(e) as x,
      unnest(range(len(e))) as k from vec) group by all),
    profile as (select m.class, v.vec_id as concept_idx, sum(m.x * v.e[m.k + 1]) as score from means m, vec v group by all),
    z as materialized (select class, concept_idx, (score - avg(score) over w) / (stddev_pop(score) over w + 1e-8::double) as z
      from profile window w as (partition by concept_idx)),
    gram as (select i, list(v order by j) as r from (select a.class as i, b.class as j, sum(a.z * b.z) as v
      from z a join z b using (concept_idx) group by all) group by i),
    power as (select 0 as step, list(r order by i) as g from gram union all
      select step + 1, list_transform(g, lambda r: list_transform(g, lambda c: list_dot_product(r, c)
          / list_sum(list_transform(g, lambda x: list_dot_product(x, x))))) from power where step < 40),
    projector as (select i, j, g[a][b] as u from (select step, g, unnest(range(1, len(g) + 1)) as a from power where step = 40)
      join (select i, row_number() over (order by i) as a from gram) using (a),
      (select i as j, row_number() over (order by i) as b from gram)),
    shares as (select i as class, concept_idx, sum(u * z) as s from projector join z on z.class = j group by all)
  select class, concept_idx, round(z - s, 6) as score from z join shares using (class, concept_idx)""")
def standardize_debias(spark, sf):
    rows = I.vectors(spark, sf).withColumnRenamed("label", "class")
    phrases = I.vectors(spark, sf).select(F.col("vec_id").alias("concept_idx"),
                                          F.col("embedding").alias("direction"))
    # The id of a vector is its place, as ids are 0, 1, ...
    profiles = linalg.phrase_usage_profiles(rows, phrases)
    return linalg.standardize_debias(profiles, 1).select("class", F.posexplode("scores").alias("concept_idx", "s")).select(
        "class", F.col("concept_idx").cast("long").alias("concept_idx"), r6("s", "score"))


# DuckDB has no error function: its power series is exact here, as |z| stays below 2.
@query("apply_adapter", "vec", """, hid as (select vec_id, h, sum(x * sin((h + 1) * (k + 1)) / 8)
      + 0.01::double * h as z from (select vec_id, unnest(e) as x, unnest(range(len(e))) as k from vec),
      (select unnest(range(16)) as h) group by vec_id, h),
    gelu as (select vec_id, h, 0.5 * z * (1 + 2 / sqrt(pi()) * list_sum(list_transform(range(30),
      lambda n: pow(-1, n) * pow(z / sqrt(2), 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))) as g from hid)
  select vec_id, o, round(sum(g * cos((o + 1) * (h + 1)) / 4) + 0.02::double * o, 6) as value
  from gelu, (select unnest(range(8)) as o) group by vec_id, o""")
def apply_adapter(spark, sf):
    return _adapted(spark, sf)


def _adapted(spark, sf):
    first = spark.range(16).select(F.lit(1).alias("layer"), F.col("id").cast("int").alias("row"))
    second = spark.range(8).select(F.lit(2).alias("layer"), F.col("id").cast("int").alias("row"))

    def weights(rows, width, wave, scale, bias):
        cells = F.transform(F.sequence(F.lit(1), F.lit(width)),
                            lambda k: wave((F.col("row") + 1) * k) / scale)
        return rows.select("layer", "row", cells.alias("weight"), (F.col("row") * bias).alias("bias"))

    table = weights(first, 64, F.sin, 8.0, 0.01).unionByName(weights(second, 16, F.cos, 4.0, 0.02))
    out = linalg.apply_adapter(I.vectors(spark, sf).select("vec_id", "embedding"), table, key="vec_id")
    return out.select("vec_id", F.posexplode("adapted").alias("o", "v")).select(
        "vec_id", F.col("o").cast("long").alias("o"), r6("v", "value"))


# ---- summaries -------------------------------------------------------------

@query("seed_summary", "seed_metrics", """select family, size, count(*) as seeds, round(avg(value), 6) as mean,
  round(coalesce(stddev_samp(value), 0), 6) as sample_std from seed_metrics group by all""")
def seed_summary(spark, sf):
    return summaries.seed_summary(I.seed_metrics(spark, sf)).select(
        "family", "size", "seeds", r6("mean"), r6("sample_std"))


@query("sweep_ranking", "seed_metrics", """, wide as (select family || '-s' || seed as config,
      max(value) filter (size = 4) as a, max(value) filter (size = 8) as b,
      max(value) filter (size = 14) as c from seed_metrics group by all)
  select config, round(a, 6) as recall_k4, round(b, 6) as recall_k8, round(c, 6) as recall_k14,
    round((a + b + c) / 3, 6) as mean_recall from wide""")
def sweep_ranking(spark, sf):
    curves = I.seed_metrics(spark, sf).select(F.concat("family", F.lit("-s"), F.col("seed").cast("string"))
                                              .alias("config"), "size", F.col("value").alias("recall"))
    return summaries.sweep_ranking(curves).select("config", *[r6(c) for c in (
        "recall_k4", "recall_k8", "recall_k14", "mean_recall")])


@query("seed_paired_difference", "seed_metrics", """, d as (select size, a.value - b.value as d
    from seed_metrics a join seed_metrics b using (size, seed)
    where a.family = 'purchase' and b.family = 'view')
  select size, count(*) as seeds, round(avg(d), 6) as mean_difference, round(stddev_samp(d), 6) as sample_std,
    round(avg(d) - 2.447 * stddev_samp(d) / sqrt(count(*)), 6) as low,
    round(avg(d) + 2.447 * stddev_samp(d) / sqrt(count(*)), 6) as high from d group by size""")
def seed_paired_difference(spark, sf):
    d = summaries.seed_paired_difference(I.seed_metrics(spark, sf), "purchase", "view", 2.447)
    return d.select("size", "seeds", *[r6(c) for c in ("mean_difference", "sample_std", "low", "high")])


@query("chart_series", "seed_metrics runs", """, cohort as (select count(distinct image_id) as n from runs)
  select family, size, round(avg(value), 6) as mean,
    round(coalesce(stddev_samp(value), 0), 6) as sample_std, (select n from cohort) as cohort
  from seed_metrics group by all""")
def chart_series(spark, sf):
    summary = summaries.seed_summary(I.seed_metrics(spark, sf))
    runs = I.event_runs(spark, sf).select("image_id").distinct().agg(F.count("*").alias("images"))
    cohorts = with_row(summary.select("family", "size"), runs)
    return summaries.chart_series(summary, cohorts).select(
        "family", "size", r6("mean"), r6("sample_std"), "cohort")


@query("telemetry_summary", "", """select event_type as metric, count(*) as samples,
    round(avg(value), 6) as mean, max(value) as max,
    round(100 * avg((value >= 90)::int), 6) as busy_pct, round(quantile_cont(value, 0.5), 6) as p50,
    round(quantile_cont(value, 0.95), 6) as p95 from events group by all""")
def telemetry_summary(spark, sf):
    samples = I.table(spark, sf, "events").select(F.col("event_type").alias("metric"), "value")
    t = summaries.telemetry_summary(samples)
    return t.select("metric", "samples", r6("mean"), "max", r6("busy_pct"), r6("p50"), r6("p95"))


@query("throughput_summary", "runs", """select run_id, count(*) filter (status = 'ok') as completed,
    count(*) filter (status <> 'ok') as failed, round(s, 3) as seconds,
    round(count(*) / s, 6) as items_per_second
  from (select *, (epoch_us(max(created_at) over (partition by run_id))
    - epoch_us(min(created_at) over (partition by run_id))) / 1e6::double as s from runs)
  group by run_id, s""")
def throughput_summary(spark, sf):
    t = summaries.throughput_summary(I.event_runs(spark, sf))
    return t.select("run_id", "completed", "failed", F.round("seconds", 3).alias("seconds"),
                    r6("items_per_second"))


# ---- dictionary ------------------------------------------------------------

#: Decisions name the slice of their edge too, so they meet where the ranking has put the edges.
_BY = ("slice", "edge_id")


def _phrases(spark, sf):
    return I.vectors(spark, sf).select(F.format_string("v%06d", "vec_id").alias("phrase"),
                                       "embedding", "label")


def _edges(spark, sf):
    phrases = _phrases(spark, sf)
    return phrases, similarity.propose_merge_edges(phrases, I.EDGE_THRESHOLD)


def _decisions(spark, sf):
    """Every edge decided by its ends' labels; some undecided, some decided twice."""
    phrases = _phrases(spark, sf)
    edges = similarity.propose_merge_edges(phrases, I.EDGE_THRESHOLD, slice_name="slice")
    # Written, the labels have their real size: their joins then leave the edges where they are.
    label = materialize(phrases.select("phrase", "label"))
    both = (edges.join(label.toDF("left", "_l"), "left").join(label.toDF("right", "_r"), "right"))
    times = F.when(F.col("_l") == 4, 2).otherwise(1)
    return phrases, edges, both.where("_l <> 3").select(
        *_BY, F.explode(F.array_repeat(F.col("_l") == F.col("_r"), times)).alias("equivalent"))


_DECIDED = """, numbered as (select *, format('e{:06d}', row_number() over (order by cosine desc, l, r) - 1)
      as edge_id from edges), judged as (select n.*, v.label as ll from numbered n join vec v on v.vec_id = l)"""


@query("apply_edge_decisions", "edges", _DECIDED + """ select edge_id, format('v{:06d}', l) as "left",
    format('v{:06d}', r) as "right", round(cosine, 6) as weight from judged
  where equivalent and ll not in (3, 4)""")
def apply_edge_decisions(spark, sf):
    _phrases, edges, decisions = _decisions(spark, sf)
    return joins.accepted_edges(edges, decisions, weighted=True, by=_BY).select("edge_id", "left", "right", r6("weight"))


@query("edge_decision_violations", "edges", _DECIDED + """ select edge_id,
    case ll when 3 then 'undecided' else 'decided_twice' end as rule from judged where ll in (3, 4)""")
def edge_decision_violations(spark, sf):
    phrases, edges, decisions = _decisions(spark, sf)
    return joins.edge_decision_violations(edges, decisions, phrases, by=_BY)


@query("adjudicate_edges", "edges", _DECIDED + """ select edge_id, cosine >= 0.45::double as equivalent
  from judged""")
def adjudicate_edges(spark, sf):
    from axisframe.operators.annotate import adjudicate_edges as judge_all

    _phrases, edges = _edges(spark, sf)

    def judge(batch):
        return {e: float(c) >= I.MERGE_THRESHOLD for e, c in zip(batch["edge_id"], batch["left"])}

    # The judge sees edge and phrases only, as a model would; here the left text carries the cosine.
    shown = edges.select("edge_id", F.col("text_cosine").cast("string").alias("left"), "right")
    return judge_all(shown, judge)


@query("parse_edge_decisions", "edges", _DECIDED + """, batched as (select *,
      cast(substring(edge_id, 2) as bigint) // 64 as batch_id from judged)
  select batch_id, edge_id, equivalent, null::varchar as reason from batched
    where batch_id not in (1, 2, 3)
  union all select distinct batch_id, null, null::boolean, case batch_id when 1 then 'no_json_object'
    when 2 then 'ids_differ' else 'not_boolean' end from batched where batch_id in (1, 2, 3)""")
def parse_edge_decisions(spark, sf):
    from axisframe.operators.textjobs import parse_edge_decisions as parse

    phrases, edges = _edges(spark, sf)
    label = materialize(phrases.select("phrase", "label"))
    both = edges.join(label.toDF("left", "_l"), "left").join(label.toDF("right", "_r"), "right")
    # A batch is one answer of the judge about 64 edges.
    number = F.substring("edge_id", 2, 20).cast("long")
    batches = both.groupBy(F.floor(number / 64).cast("long").alias("batch_id")).agg(
        F.collect_list("edge_id").alias("ids"),
        F.array_join(F.collect_list(F.concat(F.lit('"'), "edge_id", F.lit('": '),
                                             (F.col("_l") == F.col("_r")).cast("string"))), ", ").alias("m"))
    text = F.concat(F.lit("```json\n{"), "m", F.lit("}\n```"))
    broken = (F.when(F.col("batch_id") == 1, F.lit("no answer"))
              .when(F.col("batch_id") == 2, F.regexp_replace(text, r"\{", '{"extra": true, '))
              .when(F.col("batch_id") == 3, F.regexp_replace(text, ": (true|false)", ': "$1"'))
              .otherwise(text))
    return parse(batches.select("batch_id", "ids", broken.alias("content")))


def _clustered(spark, sf, linkage, floor):
    # Clusters need no edge ids, so the edges are not sorted.
    phrases = I.vectors(spark, sf).select(F.format_string("v%06d", "vec_id").alias("phrase"), "embedding")
    weights = similarity.cosine_edges(phrases, I.EDGE_THRESHOLD, "phrase").withColumnRenamed("cosine", "weight")
    return clustering.cluster_phrases(phrases.select("phrase"), "adjudicated", adjudicated=weights,
                                      linkage=linkage, min_similarity=floor)


def _merges(e: str, value: str, kept: str) -> str:
    """Clusters by rounds in which all mutually nearest ones merge; ``kept`` says which links count."""
    return f""", e as materialized ({e}),
  c as (select 0 as i, vec_id as v, vec_id as cl, true as moved from vec union all
    select i + 1, v, coalesce(lo, cl), bool_or(lo is not null) over () from c left join (
      with p as (select least(x.cl, y.cl) as a, greatest(x.cl, y.cl) as b, max(d) as far, sum(s) as s, count(*) as k
          from e join c x on x.v = e.l join c y on y.v = e.r where x.cl <> y.cl group by 1, 2),
        n as (select cl, count(*) as n from c group by cl),
        ok as (select a, b, {value} as d from p join n na on na.cl = a join n nb on nb.cl = b where {kept}),
        ends as (select a as x, a, b, d from ok union all select b, a, b, d from ok),
        best as (select x, min({{'d': d, 'a': a, 'b': b}}) as m from ends group by x)
      select m.a as lo, m.b as hi from best group by 1, 2 having count(*) = 2) on cl = hi
    where moved)
  select format('v{{:06d}}', v) as phrase, format('v{{:06d}}', cl) as cluster from c
  where i = (select max(i) from c)"""


_COMPLETE = _merges(f"""select l, r, greatest(1 - cosine, 0) as d, 0 as s from edges
    where cosine >= {I.MERGE_THRESHOLD}::double""", "far", f"k = na.n * nb.n and d <= 1 - {I.MERGE_THRESHOLD}::double")
_AVERAGE = _merges("""select l, r, 0 as d, floor(cosine * 1073741824 + 0.5)::bigint as s from edges""",
                   "1 - s::double / 1073741824 / (na.n * nb.n)", "d <= 1 - 0.35::double")


@query("cluster_phrases", "edges", _COMPLETE)
def cluster_phrases(spark, sf):
    phrases = I.vectors(spark, sf).select(F.format_string("v%06d", "vec_id").alias("phrase"), "embedding")
    near = similarity.cosine_edges(phrases, I.MERGE_THRESHOLD, "phrase")
    return clustering.cluster_phrases(phrases.select("phrase"), "text", text_edges=near,
                                      text_threshold=I.MERGE_THRESHOLD)


@query("summarize_clusters", "vec", """, cells as (select 'label ' || label as cluster, i, unnest(e) as x,
      unnest(range(len(e)))::int as k, vec_id from (select *, vec_id as i from vec)),
    means as (select cluster, k, avg(x) as x, count(distinct vec_id) as n, min(vec_id) as first from cells group by all),
    shape as (select cluster, avg(x) as m, stddev_pop(x) as s from means group by cluster),
    size as (select cluster, sqrt(sum(x * x)) as s from means where k < 16 group by cluster)
  select cluster, format('v{:06d}', first) as name, n as members, k, round((x - m) / (shape.s + 1e-8::double), 6) as profile,
    case when k < 16 then round(x / greatest(size.s, 1e-8::double), 6) end as text_value
  from means join shape using (cluster) join size using (cluster)""")
def summarize_clusters(spark, sf):
    """Vectors as phrases and labels as clusters; the text vector is the head of the embedding."""
    vectors = materialize(I.vectors(spark, sf).select(
        F.format_string("v%06d", "vec_id").alias("phrase"), F.concat(F.lit("label "), "label").alias("cluster"),
        F.col("embedding").alias("profile"), F.slice("embedding", 1, 16).alias("text_vector")))
    clusters = vectors.select("phrase", "cluster")
    stats = clusters.groupBy("cluster").agg(F.count("*").alias("mentions"))
    leaders = clusters.groupBy("cluster").agg(F.min("phrase").alias("name"))
    found = clustering.summarize_clusters(clusters, clusters, vectors.drop("cluster"), stats, leaders)
    cells = found.select("cluster", "name", F.size("members").cast("long").alias("members"), "text_vector",
                         F.posexplode("profile").alias("k", "p"))
    return cells.select("cluster", "name", "members", "k", r6("p", "profile"),
                        r6(F.try_element_at("text_vector", F.col("k") + 1), "text_value"))


@query("cluster_phrases_average", "edges", _AVERAGE)
def cluster_phrases_average(spark, sf):
    return _clustered(spark, sf, "average", 0.35)


@query("cluster_phrases_lexical", "words", """, compact as (select phrase,
    replace(phrase, 'grey', 'gray') as c from (select distinct phrase from words)),
  keyed as (select phrase, case
    when c like '%ies' and c[:-4] || 'y' in (select c from compact) then c[:-4] || 'y'
    when c like '%s' and c not like '%ss' and c[:-2] in (select c from compact) then c[:-2]
    else c end as k from compact)
  select phrase, min(phrase) over (partition by k) as cluster from keyed""")
def cluster_phrases_lexical(spark, sf):
    return clustering.cluster_phrases(materialize(I.words(spark, sf).select("phrase").distinct()), "lexical")


_WALK = """, near as materialized (select l, r from (select a.vec_id as l, b.vec_id as r,
      list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) as c
      from vec a join vec b on a.vec_id < b.vec_id) where c > 0.4::double),
  earlier as materialized (select r, list(l) as ls from near group by r),
  walk as (select min(vec_id) - 1 as i, []::bigint[] as kept from vec union all
    select i + 1, case when list_has_any(kept, coalesce(ls, [])) then kept
      else list_append(kept, i + 1) end
    from walk left join earlier on r = i + 1 where i < (select max(vec_id) from vec))
  select format('v{:06d}', v) as name, v + 1 as priority, position from (select unnest(kept) as v,
    unnest(range(1, len(kept) + 1)) as position from walk where i = (select max(vec_id) from vec))
  where position <= 100"""


@query("select_concepts", "vec", _WALK)
def select_concepts(spark, sf):
    v = I.vectors(spark, sf)
    concepts = v.select(F.format_string("v%06d", "vec_id").alias("name"),
                        (F.col("vec_id") + 1).alias("priority"), F.col("embedding").alias("text_vector"))
    chosen, _skipped = selection.select_distinct(concepts, "text", 100, max_text=0.4)
    return chosen.select("name", "priority", "position")


def _dictionary_inputs(spark, sf):
    """Mentions of every document, and a vector of each: its embedding, or one made from its digest."""
    digest = F.sha2("text", 512)
    made = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(
        F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    docs = I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("vec_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("image_id"),
        F.col("source").alias("class"), made.alias("made"))
    known = I.vectors(spark, sf).select("vec_id", "embedding")
    keyed = docs.join(known, "vec_id", "left").select(
        "image_id", "class", F.coalesce("embedding", "made").alias("embedding"))
    # Tokenizing every document is dearer than keeping its distinct words once.
    return materialize(I.words(spark, sf)), materialize(keyed)


@query("dictionary_build")
def dictionary_build(spark, sf):
    from axisframe.plans.dictionary import DictionaryOptions, build_dictionary

    mentions, images = _dictionary_inputs(spark, sf)
    # A phrase's vector is the mean embedding of the documents that use it.
    # Rarer phrases than a candidate may be need none.
    often = mentions.groupBy("phrase").agg(F.count("*").alias("n")).where("n >= 12").select("phrase")
    used = mentions.join(often, "phrase", "left_semi").select("phrase", "image_id")
    phrase_vectors = linalg.paired_means(used, images, "phrase", "image_id", "embedding", mentions.count())
    options = DictionaryOptions(k=64, min_mentions=12, min_class_support=8, merge_method="text",
                                text_threshold=0.92, remove_components=1, selection="profile-and-text",
                                max_profile_twin=0.75, max_text_twin=0.9)
    built = build_dictionary(mentions, images, phrase_vectors, options)
    return built.dictionary.select("name", F.array_join("members", ",").alias("members"),
                                   r6("prevalence"), r6("image_prevalence"), "mentions", "class_support")


def _recursive() -> None:
    from axisframe.plans.registry import ORACLES

    for name in ("select_concepts", "cluster_phrases", "cluster_phrases_average", "reverse_ridge",
                 "reverse_ridge_summary", "reverse_ridge_profile",
                 "standardize_debias", "concept_support_mask", "fit_soft_labels"):
        ORACLES[name] = ORACLES[name].replace("with ", "with recursive ", 1)


_recursive()
