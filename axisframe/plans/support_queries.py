"""Registered queries: tag support, keys, splits, samples and exemplars."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisframe.functions import columns as C
from axisframe.operators import joins, sampling, summaries, support, textjobs
from axisframe.plans import inputs as I
from axisframe.plans.registry import query
from axisframe.session import materialize

r6 = I.r6

_SUPPORT = """per as (select phrase, class, count(*) as n from {m} group by all),
  tot as (select class, count(distinct image_id) as t from {m} group by class),
  sup as (select phrase, sum(n)::bigint as mentions, count(*) as class_support,
    sum(n / t::double) / (select count(*) from tot) as balanced from per join tot using (class)
    group by phrase)"""


def _support_sql(m: str, rest: str) -> str:
    return ", " + _SUPPORT.format(m=m) + " " + rest


@query("attribute_support", "tags", _support_sql("tags", """select phrase, mentions, class_support,
  round(balanced, 6) as balanced_prevalence from sup"""))
def attribute_support(spark, sf):
    s = support.attribute_support(I.tags(spark, sf), I.tag_images(spark, sf))
    return s.select("phrase", "mentions", "class_support", r6("balanced_prevalence"))


@query("attribute_support_words", "words", _support_sql("words", """select phrase, mentions,
  class_support, round(balanced, 6) as balanced_prevalence from sup"""))
def attribute_support_words(spark, sf):
    s = support.attribute_support(I.words(spark, sf), I.word_images(spark, sf))
    return s.select("phrase", "mentions", "class_support", r6("balanced_prevalence"))


_STATS = """select phrase as attribute, mentions as images, class_support as classes,
  round(mentions / (select sum(t) from tot)::double, 6) as image_prevalence,
  round(class_support / (select count(*) from tot)::double, 6) as class_coverage,
  round(balanced, 6) as balanced_prevalence,
  row_number() over (order by mentions desc, class_support desc, phrase) as rank from sup"""


def _rounded_stats(df):
    return df.select("attribute", "images", "classes", r6("image_prevalence"), r6("class_coverage"),
                     r6("balanced_prevalence"), F.col("rank").cast("long"))


@query("attribute_statistics", "tags", _support_sql("tags", _STATS))
def attribute_statistics(spark, sf):
    return _rounded_stats(support.attribute_statistics(I.tags(spark, sf), I.tag_images(spark, sf)))


@query("attribute_statistics_words", "words", _support_sql("words", _STATS))
def attribute_statistics_words(spark, sf):
    return _rounded_stats(support.attribute_statistics(I.words(spark, sf), I.word_images(spark, sf)))


@query("filter_support", "words", _support_sql("words", """select phrase, mentions, class_support
  from sup where mentions >= 20 and class_support >= 5"""))
def filter_support(spark, sf):
    s = support.attribute_support(I.words(spark, sf), I.word_images(spark, sf))
    return support.filter_support(s, 20, 5).select("phrase", "mentions", "class_support")


_NEGATED = """neg as (select phrase, arg_min(base, o) as base from (
    select s.phrase, p.o, substring(replace(s.phrase, '-', ''), length(p.prefix) + 1) as base
    from sup s join (values (0, 'in'), (1, 'un'), (2, 'non'), (3, 'anti'), (4, 'dis')) p(o, prefix)
      on starts_with(replace(s.phrase, '-', ''), p.prefix)) t
  where base in (select phrase from sup) group by phrase)"""


@query("exclude_lexical_negations", "words", _support_sql("words", ", " + _NEGATED + """
  select s.phrase, base, base is null as kept from sup s left join neg using (phrase)"""))
def exclude_lexical_negations(spark, sf):
    phrases = materialize(I.words(spark, sf).select("phrase").distinct())
    kept, negated = support.exclude_lexical_negations(phrases)
    return kept.select("phrase", F.lit(None).cast("string").alias("base"),
                       F.lit(True).alias("kept")).unionByName(
        negated.withColumn("kept", F.lit(False)))


@query("lexical_variant_key", "words", """, compact as (select phrase,
    replace(regexp_replace(lower(phrase), '[\\s_-]+', '', 'g'), 'grey', 'gray') as c
    from (select distinct phrase from words))
  select phrase, case
    when c like '%ies' and c[:-4] || 'y' in (select c from compact) then c[:-4] || 'y'
    when c like '%s' and c not like '%ss' and c[:-2] in (select c from compact) then c[:-2]
    else c end as variant_key from compact""")
def lexical_variant_key(spark, sf):
    return support.lexical_variant_key(materialize(I.words(spark, sf).select("phrase").distinct()))


# Clusters of the tag phrases for the cluster reports: one per first letter.
def _tag_rows(spark, sf):
    """The tag rows, joined once for all that a query reads from them; each is one tagged image."""
    return materialize(I.tag_rows(spark, sf))


def _letters(mentions):
    phrases = mentions.select("phrase").distinct()
    return phrases.select("phrase", F.substring("phrase", 1, 1).alias("cluster"))


_CLUSTERS = """active as (select distinct image_id, class, substring(phrase, 1, 1) as cluster from tags),
  cper as (select cluster, class, count(*) as n from active group by all),
  csup as (select cluster, sum(n)::bigint as mentions, count(*) as class_support,
    sum(n / t::double) / (select count(*) from tot) as prevalence,
    sum(n) / (select sum(t) from tot)::double as image_prevalence
    from cper join tot using (class) group by cluster)"""
_LEADER = """lead as (select substring(phrase, 1, 1) as cluster, phrase as name, row_number() over (
    partition by substring(phrase, 1, 1) order by round(balanced, 9) desc, class_support desc,
    mentions desc, phrase) as rn, count(*) over (partition by substring(phrase, 1, 1)) as members from sup)"""


@query("cluster_support", "tags", _support_sql("tags", ", " + _CLUSTERS + """
  select cluster, mentions, class_support, round(prevalence, 6) as prevalence,
    round(image_prevalence, 6) as image_prevalence from csup"""))
def cluster_support(spark, sf):
    rows = _tag_rows(spark, sf)
    mentions = I.mentions_of(rows)
    s = support.cluster_support(mentions, _letters(mentions), rows.select("image_id", "class"))
    return s.select("cluster", "mentions", "class_support", r6("prevalence"), r6("image_prevalence"))


@query("cluster_leader", "tags", _support_sql("tags", ", " + _LEADER + """
  select cluster, name, members from lead where rn = 1"""))
def cluster_leader(spark, sf):
    found = support.attribute_support(I.tags(spark, sf), I.tag_images(spark, sf))
    return support.cluster_leader(found, found.select(
        "phrase", F.substring("phrase", 1, 1).alias("cluster")))


@query("concept_priority", "tags", _support_sql("tags", ", " + _CLUSTERS + ", " + _LEADER + """
  select name, cluster, row_number() over (order by round(prevalence, 9) desc, c.class_support desc,
    c.mentions desc, name) as priority from csup c join lead using (cluster) where rn = 1"""))
def concept_priority(spark, sf):
    rows = _tag_rows(spark, sf)
    mentions, images = I.mentions_of(rows), rows.select("image_id", "class")
    found = materialize(support.attribute_support(mentions, images))
    clusters = _letters(found)
    stats = support.cluster_support(mentions, clusters, images)
    names = support.cluster_leader(found, clusters)
    ordered = support.concept_priority(stats.join(names.select("cluster", "name"), "cluster"))
    return ordered.select("name", "cluster", F.col("priority").cast("long"))


@query("tag_volume", "tags", """select count(*) as mentions, count(distinct phrase) as distinct_tags,
  count(distinct image_id) as images from tags""")
def tag_volume(spark, sf):
    return support.tag_volume(I.tags(spark, sf))


@query("top_tags", "words", """select phrase, count(*) as mentions from words group by phrase
  order by mentions desc, phrase limit 20""")
def top_tags(spark, sf):
    return support.top_tags(I.words(spark, sf))


@query("frequency_report", "words", _support_sql("words", """select phrase as attribute,
  mentions as images, class_support as classes, round(balanced, 6) as balanced_prevalence from (
    select *, row_number() over (order by mentions desc, class_support desc, phrase) as rank from sup)
  where contains(phrase, 'en') order by round(balanced, 9) desc, mentions desc, rank limit 50"""))
def frequency_report(spark, sf):
    stats = support.attribute_statistics(I.words(spark, sf), I.word_images(spark, sf))
    return support.frequency_report(stats, "en", "balanced", 50).select(
        "attribute", "images", "classes", r6("balanced_prevalence"))


@query("filter_nonempty_tags", "images tag_rows", """select image_id, len(attributes) as tags
  from images join tag_rows using (image_id) where len(attributes) > 0""")
def filter_nonempty_tags(spark, sf):
    every = I.images(spark, sf).select("image_id").join(
        I.tag_rows(spark, sf).select("image_id", "attributes"), "image_id", "left")
    return joins.filter_nonempty_tags(every).select(
        "image_id", F.size("attributes").cast("long").alias("tags"))


# ---- keys, splits, samples -------------------------------------------------

_URL = "replace(replace(url, 'http://', ''), 'https://', '')"


def _page_ids(spark, sf):
    bare = F.regexp_replace("url", "https?://", "")
    return I.table(spark, sf, "pages").select("page_id", bare.alias("image_id"))


@query("image_class", "", f"""select page_id, case when contains(u, '/') then split_part(u, '/', 1)
    else regexp_replace(u, '^(.+)\\.[^.]+$', '\\1') end as class
  from (select page_id, replace({_URL}, '\\', '/') as u from pages)""")
def image_class(spark, sf):
    return _page_ids(spark, sf).select("page_id", C.image_class("image_id").alias("class"))


@query("subject_label", "images", """select image_id, trim(replace(
    regexp_replace(class, '\\d+$', ''), '_', ' ')) as by_class,
    replace(regexp_replace(class, '\\d+$', ''), '_', ' ') as by_parent from images""")
def subject_label(spark, sf):
    return I.images(spark, sf).select("image_id", C.subject_label("image_id").alias("by_class"),
                                      C.subject_label("image_id", "parent").alias("by_parent"))


@query("assign_class_splits", "source_splits", "select class, split from source_splits")
def assign_class_splits(spark, sf):
    return I.source_splits(spark, sf)


@query("join_split", "images nation_splits",
       "select image_id, split from images join nation_splits using (class)")
def join_split(spark, sf):
    return joins.join_split(I.images(spark, sf), I.nation_splits(spark, sf)).select(
        "image_id", "split")


@query("filter_split", "images nation_splits",
       "select image_id, class from images join nation_splits using (class) where split = 'dev'")
def filter_split(spark, sf):
    return joins.filter_split(I.images(spark, sf), I.nation_splits(spark, sf), "dev").select(
        "image_id", "class")


@query("split_counts", "images nation_splits", """select split, count(distinct class) as classes,
  count(*) as images from images join nation_splits using (class) group by split""")
def split_counts(spark, sf):
    return sampling.split_counts(joins.join_split(I.images(spark, sf), I.nation_splits(spark, sf)))


@query("hash_priority_sample", "images", """select image_id from images
  order by sha256('42' || chr(0) || image_id), image_id limit 500""")
def hash_priority_sample(spark, sf):
    return sampling.hash_priority_sample(I.images(spark, sf).select("image_id"), 500, 42)


@query("seeded_shuffle_limit", "images", """select image_id, place as pos from (
    select image_id, row_number() over (order by sha256('7' || chr(0) || image_id), image_id) - 1 as place
    from images) where place < 1000""")
def seeded_shuffle_limit(spark, sf):
    rows = I.images(spark, sf).select("image_id")
    return sampling.seeded_shuffle_limit(rows, 1000, 7).select("image_id", F.col("pos").cast("long"))


@query("explicit_id_list", "images nation_splits", """, wanted as (select row_number() over (
      order by sha256('3|' || image_id), image_id) as pos, image_id from images)
  select wanted.pos, image_id, case when split = 'train' then 'ok' else 'wrong_split' end as rule
  from wanted join images using (image_id) join nation_splits using (class)""")
def explicit_id_list(spark, sf):
    from axisframe.operators.ranking import ranked

    every = joins.join_split(I.images(spark, sf), I.nation_splits(spark, sf))
    wanted = ranked(every.select("image_id"), [C.hash_priority(3, "image_id"), "image_id"], name="pos")
    good, bad = joins.explicit_id_list(every, wanted, "train")
    return good.withColumn("rule", F.lit("ok")).unionByName(bad).select(
        F.col("pos").cast("long"), "image_id", "rule")


# ---- dictionary lookups and exemplars --------------------------------------

def _dictionary(spark, sf, rows=None):
    """One concept per letter of the tag phrases, named by its leader."""
    rows = _tag_rows(spark, sf) if rows is None else rows
    found = materialize(support.attribute_support(I.mentions_of(rows), rows.select("image_id", "class")))
    clusters = found.select("phrase", F.substring("phrase", 1, 1).alias("cluster"))
    names = support.cluster_leader(found, clusters)
    # A cluster holds a dictionary entry's members, not rows of the data.
    members = clusters.groupBy("cluster").agg(F.sort_array(F.collect_list("phrase")).alias("members"))
    order = F.ascii("cluster").alias("concept_idx")
    return materialize(members.join(names.select("cluster", "name"), "cluster")
                       .select(order, "name", "members"))


_DICT = _SUPPORT.format(m="tags") + ", " + _LEADER + """,
  dict as (select ascii(substring(phrase, 1, 1)) as concept_idx, l.name, phrase as member
    from sup join lead l on l.cluster = substring(phrase, 1, 1) and l.rn = 1)"""
_FLAGGED = ["small", "ring"]


@query("map_tags_to_concepts", "tags", ", " + _DICT + """ select distinct image_id, concept_idx, name
  from tags join dict on member = phrase""")
def map_tags_to_concepts(spark, sf):
    rows = _tag_rows(spark, sf)
    return joins.map_tags_to_concepts(rows, _dictionary(spark, sf, rows))


@query("drop_flagged_concepts", "tags", ", " + _DICT + """, flagged as (select distinct phrase as name
    from tags where phrase in ('small', 'ring'))
  select distinct image_id, name from tags join dict on member = phrase
  where name not in (select name from flagged)""")
def drop_flagged_concepts(spark, sf):
    rows = _tag_rows(spark, sf)
    flagged = I.mentions_of(rows).where(F.col("phrase").isin(*_FLAGGED)).select(
        F.col("phrase").alias("name")).distinct()
    return joins.map_tags_to_concepts(rows, _dictionary(spark, sf, rows),
                                      flagged=flagged).select("image_id", "name")


def _exemplars(spark, sf):
    rows = _tag_rows(spark, sf)
    dictionary = _dictionary(spark, sf, rows)
    terms = dictionary.select("name", F.explode("members").alias("term"))
    return joins.tag_backed_exemplars(rows, terms), dictionary


_HITS = """hits as (select name, image_id, string_agg(phrase, ',' order by phrase) as matched,
    bool_or(phrase = name) as has_name, count(*) as k from tags join dict on member = phrase
    group by all)"""


@query("tag_backed_exemplars", "tags", ", " + _DICT + ", " + _HITS + """
  select name, image_id, matched, has_name from hits""")
def tag_backed_exemplars(spark, sf):
    found = _exemplars(spark, sf)[0]
    return found.select("name", "image_id", F.array_join("matched", ",").alias("matched"), "has_name")


@query("exemplar_coverage", "tags", ", " + _DICT + ", " + _HITS + """
  select count(*) as concepts, count(named) as covered, count(*) filter (named) as named
  from (select distinct name from dict) left join (
    select name, bool_or(has_name) as named from hits group by name) using (name)""")
def exemplar_coverage(spark, sf):
    return joins.exemplar_coverage(*_exemplars(spark, sf))


@query("diverse_examples", "tags", ", " + _DICT + ", " + _HITS + """, placed as (
    select *, row_number() over (partition by name, split_part(image_id, '/', 1)
      order by not has_name, -k, image_id) as rc from hits)
  select name, image_id, place from (select name, image_id, row_number() over (partition by name
    order by rc > 1, not has_name, -k, image_id) as place from placed) where place <= 40""")
def diverse_examples(spark, sf):
    found = _exemplars(spark, sf)[0].select(
        "name", "image_id", (~F.col("has_name")).alias("unnamed"),
        (-F.size("matched")).alias("neg_matches"))
    return summaries.diverse_examples(found, 40, order=["unnamed", "neg_matches"])


@query("concept_search", "tags", ", " + _DICT + """ select distinct d.concept_idx, d.name from dict d
  where contains(lower(d.name), 'g') or d.name in (select name from dict where contains(member, 'g'))""")
def concept_search(spark, sf):
    return textjobs.concept_search(_dictionary(spark, sf), "G").select("concept_idx", "name")


@query("gallery_page", "images tag_rows nation_splits", """select pos, image_id,
    array_to_string(attributes, ',') as tags from images join tag_rows using (image_id, class)
    join nation_splits using (class) where split = 'dev' order by pos limit 60""")
def gallery_page(spark, sf):
    rows = I.images(spark, sf).join(I.tag_rows(spark, sf).drop("class"), "image_id")
    dev = joins.filter_split(rows, I.nation_splits(spark, sf), "dev", class_col="class")
    return summaries.gallery_page(dev, 60).select(
        "pos", "image_id", F.array_join("attributes", ",").alias("tags"))
