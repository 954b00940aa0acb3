"""Registered queries: contracts, resume joins, label diagnostics and text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisframe.operators import contracts, joins, labels, textjobs
from axisframe.operators.scalars import with_row
from axisframe.plans import inputs as I
from axisframe.plans.registry import query
from axisframe.sources.readers import long_to_wide_scores, wide_to_long_scores

r6 = I.r6
NAMES = I.LABEL_NAMES
_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"

# ---- contracts -------------------------------------------------------------

_RULES = f"""unknown as (select image_id, source, list_sort(list_filter(
      list_distinct(list_concat(present, uncertain)), lambda x: not list_contains({_NAMES}, x))) as u,
    list_sort(list_intersect(present, uncertain)) as o, status from broken_shards),
  rules as (select image_id, 'unknown_name' as rule, array_to_string(u, ',') as detail from unknown
      where len(u) > 0
    union all select image_id, 'overlap', array_to_string(o, ',') from unknown where len(o) > 0
    union all select image_id, 'non_success', status from unknown where status <> 'ok')"""


@query("merge_label_shards", "shards manifest source_splits", """select m.pos, s.image_id, s.source,
    array_to_string(s.present, ',') as present from shards s join manifest m using (image_id)
    join source_splits p using (class) where p.split = 'train'""")
def merge_label_shards(spark, sf):
    train = _keyed_splits(spark, sf).where("split = 'train'").select(
        F.col("class").cast("long").alias("image_id"))
    merged, _violations, _counts = contracts.merge_label_shards(
        I.label_shards(spark, sf).join(train, "image_id", "left_semi"), NAMES,
        I.document_manifest(spark, sf), _keyed_splits(spark, sf), "train")
    return merged.select("pos", "image_id", "source", F.array_join("present", ",").alias("present"))


def _keyed_splits(spark, sf):
    """Splits by image key: a document id has no folder, so its class comes from the manifest."""
    by_class = I.document_manifest(spark, sf).join(I.source_splits(spark, sf), "class")
    return by_class.select(F.col("image_id").cast("string").alias("class"), "split")


@query("merge_violations", "broken_shards manifest source_splits", ", " + _RULES + """,
  expected as (select image_id from manifest join source_splits using (class) where split = 'train')
  select * from rules
  union all select image_id, 'duplicate', cast(count(*) as varchar) from broken_shards
    group by image_id having count(*) > 1
  union all select distinct image_id, 'outside_split', '' from broken_shards
    where image_id not in (select image_id from expected)
  union all select image_id, 'missing', '' from expected
    where image_id not in (select image_id from broken_shards)""")
def merge_violations(spark, sf):
    _merged, violations, _counts = contracts.merge_label_shards(
        I.label_shards(spark, sf, broken=True), NAMES, I.document_manifest(spark, sf),
        _keyed_splits(spark, sf), "train")
    return violations


@query("merge_shard_counts", "broken_shards",
       "select source, count(*) as rows from broken_shards group by source")
def merge_shard_counts(spark, sf):
    return contracts.merge_label_shards(
        I.label_shards(spark, sf, broken=True), NAMES, I.document_manifest(spark, sf),
        _keyed_splits(spark, sf), "train")[2]


@query("coverage_diff", "broken_shards manifest", """select
  count(*) filter (b.image_id is null) as missing, count(*) filter (m.image_id is null) as extra
  from (select distinct image_id from manifest) m
  full join (select distinct image_id from broken_shards) b using (image_id)""")
def coverage_diff(spark, sf):
    return contracts.coverage_diff(I.label_shards(spark, sf, broken=True),
                                   I.document_manifest(spark, sf))


@query("duplicate_ids", "broken_shards",
       "select image_id, count(*) as uses from broken_shards group by image_id having count(*) > 1")
def duplicate_ids(spark, sf):
    return contracts.duplicate_ids(I.label_shards(spark, sf, broken=True))


@query("validate_label_rows", "broken_shards", ", " + _RULES + """
  select * from rules where rule <> 'non_success'""")
def validate_label_rows(spark, sf):
    return contracts.validate_label_rows(I.label_shards(spark, sf, broken=True), NAMES)


@query("validate_label_rows_strict", "broken_shards", ", " + _RULES + """
  select image_id, case rule when 'non_success' then 'not_final' else rule end as rule, detail from rules
  union all select image_id, 'uncertain', array_to_string(list_sort(uncertain), ',') from broken_shards
    where len(uncertain) > 0""")
def validate_label_rows_strict(spark, sf):
    return contracts.validate_label_rows(I.label_shards(spark, sf, broken=True), NAMES, strict=True)


@query("class_set_equality", "images", """, tagged as (select distinct class from images),
    named as (select distinct n_name || '_' || r_name as class from nation join region
      on n_regionkey = r_regionkey union select n_name from nation where n_regionkey > 0)
  select class, 'left' as side from tagged where class not in (select class from named)
  union all select class, 'right' from named where class not in (select class from tagged)""")
def class_set_equality(spark, sf):
    nation = I.table(spark, sf, "nation")
    both = nation.join(I.table(spark, sf, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    named = both.select(F.concat("n_name", F.lit("_"), "r_name").alias("image_id")).union(
        nation.where("n_regionkey > 0").select("n_name"))
    return contracts.class_set_equality(I.images(spark, sf), named)


@query("row_order_agreement", "vec", """, four_orders as (
    select unnest(['baseline_image', 'baseline_caption', 'candidate_image', 'candidate_caption']) as name,
      vec_id as pos, vec_id as image_id, label from vec)
  select pos, count(distinct case when name = 'candidate_caption' and label = 3 then image_id + 1
      else image_id end) as ids, count(*) as arrays from four_orders
    where not (name = 'candidate_image' and label = 4) group by pos
    having count(distinct case when name = 'candidate_caption' and label = 3 then image_id + 1
      else image_id end) <> 1 or count(*) <> 4""")
def row_order_agreement(spark, sf):
    names = ["baseline_image", "baseline_caption", "candidate_image", "candidate_caption"]
    rows = I.vectors(spark, sf).select("vec_id", "label", F.explode(F.array(*map(F.lit, names)))
                                       .alias("name"))
    shifted = F.when((F.col("name") == names[3]) & (F.col("label") == 3), F.col("vec_id") + 1)
    orders = rows.where(~((F.col("name") == names[2]) & (F.col("label") == 4))).select(
        "name", F.col("vec_id").alias("pos"), F.coalesce(shifted, "vec_id").alias("image_id"))
    return contracts.row_order_agreement(orders)


def _encoder_vectors(spark, sf):
    wide, narrow = I.pairs(spark, sf), I.narrow_pairs(spark, sf)
    out = None
    for name, frame in (("baseline", wide), ("candidate", narrow)):
        for role in ("image", "caption"):
            part = frame.select("pos", F.lit(name).alias("encoder"), F.lit(role).alias("role"),
                                F.col(role).alias("vector"))
            out = part if out is None else out.unionByName(part)
    return out


@query("shape_agreement", "pairs", """, shapes as (
    select 'baseline' as encoder, 'image' as role, len(image) as d from pairs
    union all select 'baseline', 'caption', len(caption) from pairs
    union all select 'candidate', 'image', 32 from pairs
    union all select 'candidate', 'caption', 32 from pairs)
  select encoder, role, count(*) as rows, min(d) as min_dim, max(d) as max_dim, true as rows_agree,
    true as dims_agree from shapes group by all""")
def shape_agreement(spark, sf):
    return contracts.shape_agreement(_encoder_vectors(spark, sf))


@query("ordered_fingerprint", "images", """, chunks as (select pos // 4096 as c, count(*) as n,
    sha256(string_agg(image_id, chr(10) order by pos) || chr(10)) as d from images group by c)
  select sum(n)::bigint as ids, count(*) as chunks,
    sha256(string_agg(d, chr(10) order by c) || chr(10)) as sha256 from chunks""")
def ordered_fingerprint(spark, sf):
    return contracts.ordered_fingerprint(I.images(spark, sf), 4096)


# Declared and actual checksums: the text of each source's documents, some changed or absent.
_ARTIFACTS = """declared as (select source as artifact, sha256(min(sha256(text)) || max(sha256(text))
      || cast(count(*) as varchar)) as d from documents group by source),
  actual as (select artifact, case when artifact like '%7' then sha256(d) else d end as a
    from declared where artifact <> 'src3' union all select 'src_new', sha256('new') from declared
    where artifact = 'src3')"""


def _artifacts(spark, sf):
    # The digest is made of combining aggregates, so a source of any size stays spread out.
    docs = I.table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("h"))
    digest = F.sha2(F.concat(F.min("h"), F.max("h"), F.count("*").cast("string")), 256)
    declared = docs.groupBy(F.col("source").alias("artifact")).agg(digest.alias("sha256"))
    changed = F.when(F.col("artifact").endswith("7"), F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    new = declared.where("artifact = 'src3'").select(
        F.lit("src_new").alias("artifact"), F.sha2(F.lit("new"), 256).alias("sha256"))
    actual = declared.where("artifact <> 'src3'").select("artifact", changed.alias("sha256"))
    return declared, actual.unionByName(new)


@query("manifest_diff", "", "with " + _ARTIFACTS + """ select coalesce(x.artifact, y.artifact) as key,
    d as declared, case when y.artifact is null and x.artifact = 'src3' then 'legacy' else a end as actual
  from declared x full join actual y on x.artifact = y.artifact
  where d is distinct from (case when y.artifact is null and x.artifact = 'src3' then 'legacy' else a end)""")
def manifest_diff(spark, sf):
    declared, actual = (f.select(F.col("artifact").alias("key"), F.col("sha256").alias("value"))
                        for f in _artifacts(spark, sf))
    return joins.manifest_diff(declared, actual, defaults={"src3": "legacy"})


@query("artifact_identity_check", "", "with " + _ARTIFACTS + """ select y.artifact, d as declared,
    a as actual from declared x right join actual y on x.artifact = y.artifact
  where d is distinct from a""")
def artifact_identity_check(spark, sf):
    return contracts.artifact_identity_check(*_artifacts(spark, sf))


@query("pairing_check", "vec", """, sides as (
    select 'image' as side, count(*) as n, max(len(e)) as width from vec
    union all select 'caption', count(*) filter (label % 2 = 0), max(len(e)) filter (label % 2 = 0) from vec)
  select role, role = 'baseline' and max(width) = min(width) as same_encoder,
    role = 'baseline' as same_precision, max(n) = min(n) as same_rows
  from sides, (select unnest(['baseline', 'candidate']) as role) group by role""")
def pairing_check(spark, sf):
    """Manifests of two sides; the caption side lacks the vectors of odd labels, if there are any."""
    v = I.vectors(spark, sf)
    rows = None
    for side, part in (("image", v), ("caption", v.where("label % 2 = 0"))):
        ids = part.select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("image_id"))
        widths = part.agg(F.max(F.size("embedding")).alias("width"))
        digest = with_row(contracts.ordered_fingerprint(ids).select(F.col("sha256").alias("ids_sha256")), widths)
        cells = F.array(*[F.struct(
            F.lit(role).alias("role"), F.lit(side).alias("side"),
            F.concat(F.lit("width-"), (F.col("width") / (2 if (role, side) == ("candidate", "caption") else 1))
                     .cast("string")).alias("encoder"),
            F.lit("fp16" if (role, side) == ("candidate", "image") else "fp32").alias("precision"))
            for role in ("baseline", "candidate")])
        each = digest.select("ids_sha256", F.explode(cells).alias("m")).select("m.*", "ids_sha256")
        rows = each if rows is None else rows.unionByName(each)
    return contracts.pairing_check(rows)


@query("resume_anti", "runs", "select image_id from runs where status <> 'ok'")
def resume_anti(spark, sf):
    log = I.event_runs(spark, sf)
    return joins.resume_anti(log.select("image_id"), log, status="ok")


@query("skip_predecessor_shards", "broken_shards manifest", """select image_id from manifest
  where image_id not in (select image_id from broken_shards where status = 'ok')""")
def skip_predecessor_shards(spark, sf):
    work = I.document_manifest(spark, sf).select("image_id")
    return joins.skip_predecessor_shards(work, I.label_shards(spark, sf, broken=True))[0]


@query("predecessor_shard_counts", "broken_shards", """select source, count(*) as rows
  from broken_shards where status = 'ok' group by source""")
def predecessor_shard_counts(spark, sf):
    work = I.document_manifest(spark, sf).select("image_id")
    return joins.skip_predecessor_shards(work, I.label_shards(spark, sf, broken=True))[1]


@query("manifest_order", "shards manifest", """select pos, image_id, source from shards
  join manifest using (image_id)""")
def manifest_order(spark, sf):
    from axisframe.sources.sinks import manifest_order as ordered

    return ordered(I.label_shards(spark, sf), I.document_manifest(spark, sf)).select(
        "pos", "image_id", "source")


# ---- labels ----------------------------------------------------------------

@query("label_diagnostics", "label_cells", """select count(distinct image_id) as rows,
    count(distinct concept) as concepts,
    round(count(*) filter (state = 'present') / count(*)::double, 6) as positive_rate,
    round(count(*) filter (state = 'uncertain') / count(*)::double, 6) as uncertain_rate,
    (select min(p) from (select count(*) filter (state = 'present') as p from label_cells
      group by concept)) as min_positives,
    (select min(p) from (select count(*) filter (state <> 'uncertain') as p from label_cells
      group by concept)) as min_definite from label_cells""")
def label_diagnostics(spark, sf):
    d = labels.label_diagnostics(I.label_rows(spark, sf), NAMES)
    return d.select("rows", "concepts", r6("positive_rate"), r6("uncertain_rate"), "min_positives",
                    "min_definite")


@query("labels_per_image_stats", "label_rows", """select count(*) as images, min(len(present)) as min,
  round(avg(len(present)), 6) as mean, quantile_cont(len(present), 0.5)::double as median,
  max(len(present)) as max from label_rows""")
def labels_per_image_stats(spark, sf):
    return labels.labels_per_image_stats(I.label_rows(spark, sf)).select(
        "images", "min", r6("mean"), "median", "max")


@query("concept_usage_audit", "label_cells", """, used as (select concept as name,
    count(*) filter (state = 'present') as present, count(*) filter (state = 'uncertain') as uncertain
    from label_cells group by concept)
  select *, present = 0 as never_present, present + uncertain = 0 as never_used from (
    select * from used union all select 'seasonal', 0, 0 from used where name = 'quality')""")
def concept_usage_audit(spark, sf):
    return labels.concept_usage_audit(I.label_rows(spark, sf), [*NAMES, "seasonal"])


@query("present_by_split", "label_rows source_splits", """select split, count(*) as images,
    round(avg(len(present)), 6) as mean_present, round(avg(len(uncertain)), 6) as mean_uncertain,
    min(len(present)) as min_present, max(len(present)) as max_present
  from label_rows join source_splits on class = source group by split""")
def present_by_split(spark, sf):
    rows = joins.join_split(I.label_rows(spark, sf), I.source_splits(spark, sf), "source")
    return labels.present_by_split(rows).select("split", "images", r6("mean_present"),
                                                r6("mean_uncertain"), "min_present", "max_present")


@query("uncertainty_row_filter", "label_rows", f"""select image_id from label_rows
  where 1 - len(uncertain) / {len(NAMES)}::double >= 0.75""")
def uncertainty_row_filter(spark, sf):
    from axisframe.operators.directions import uncertainty_row_filter as keep

    return keep(I.label_rows(spark, sf), len(NAMES), 0.25, "uncertain").select("image_id")


@query("query_concepts", "label_rows", """select image_id, array_to_string(present, ',') as concepts
  from label_rows where len(present) > 0""")
def query_concepts(spark, sf):
    kept, _twice = labels.query_concepts(I.label_rows(spark, sf))
    return kept.select("image_id", F.array_join("query_concepts", ",").alias("concepts"))


@query("label_bitstring", "label_rows", f"""select image_id, array_to_string(list_transform({_NAMES},
    lambda n: case when list_contains(present, n) then '1' else '0' end), '') as bits,
    len(present) as yes from label_rows""")
def label_bitstring(spark, sf):
    return textjobs.label_bitstring(I.label_rows(spark, sf), NAMES)


_WIDE = ", ".join(f"max(case when concept = '{n}' then s end) as s_{n}" for n in NAMES)


@query("long_to_wide_scores", "labelled",
       f"select image_id, {_WIDE} from labelled group by image_id")
def long_to_wide(spark, sf):
    long = I.labelled_vectors(spark, sf).select("image_id", F.explode(F.arrays_zip(
        F.array(*map(F.lit, NAMES)).alias("concept"), F.col("scores").alias("score"))).alias("c")
    ).select("image_id", "c.concept", "c.score")
    return long_to_wide_scores(long, NAMES)


@query("wide_to_long_scores", "labelled", "select image_id, concept, s as score from labelled")
def wide_to_long(spark, sf):
    wide = I.labelled_vectors(spark, sf).select(
        "image_id", *[F.element_at("scores", i).alias(f"s_{n}") for i, n in enumerate(NAMES, 1)])
    return wide_to_long_scores(wide)


# ---- text jobs -------------------------------------------------------------

_NUMBER = r"'^(?:no|not|non|without|lacking)(?:[ -]|$)|(?:^|[ -])(?:absent|missing|free)$'"
_TAG_ANSWERS = """, raw as (select image_id, case class
      when 'NATION_1' then 'Tags: ' || rtrim(j, ']')
      when 'NATION_2' then j || ' ]' else '```json' || chr(10) || j || chr(10) || '```' end as content
    from (select image_id, class, '["' || array_to_string(attributes, '", "') || '", "not metallic"]' as j
      from tag_rows)
    union all select 'page/' || cast(page_id as varchar), html from pages),
  stripped as (select image_id, regexp_replace(content, '```(?:json)?', '', 'g') as t from raw),
  parsed as (select image_id, t, try_cast(nullif(regexp_extract(t, '(?s)\\[.*\\]'), '') as json) as j
    from stripped),
  items as (select image_id, case when j is not null and json_type(j) = 'ARRAY'
      then list_transform(json_extract_string(j, '$[*]'), lambda x: coalesce(x, 'none'))
      else regexp_extract_all(t, '"([^"]+)"', 1) end as v from parsed),
  numbered as (select image_id, lower(trim(regexp_replace(unnest(v), '^\\s+|\\s+$', '', 'g'))) as tag,
      unnest(range(len(v))) as i from items),
  good as (select image_id, tag, min(i) as i from numbered
    where regexp_matches(tag, '^[a-z][a-z /-]{1,30}$') and len(regexp_split_to_array(tag, ' +')) <= 2
      and not regexp_matches(tag, """ + _NUMBER + """) group by all),
  listed as (select image_id, string_agg(tag, ',' order by i) as tags, count(*) as n from good
    group by image_id)"""


@query("validate_open_tags", "tag_rows", _TAG_ANSWERS + """
  select image_id, case when n between 5 and 50 then tags end as tags,
    case when coalesce(n, 0) < 5 then 'too_few_tags' when n > 50 then 'too_many_tags' end as reason
  from raw left join listed using (image_id)""")
def validate_open_tags(spark, sf):
    parsed = textjobs.validate_open_tags(I.tag_responses(spark, sf))
    return parsed.select("image_id", F.array_join("attributes", ",").alias("tags"), "reason")


@query("validate_captions", "caption_lines", """, norm as (select image_id, trim(regexp_replace(content,
      '[\\s\\x{00A0}\\x{0085}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))
      as c from caption_lines),
  bare as (select image_id, c, case when c = '' then 0 else len(string_split(c, ' ')) end as w,
      rtrim(c, '"'')]}') as b from norm),
  judged as (select image_id, c, case when w < 8 or w > 30 then 'word_count'
      when not regexp_matches(b, '[.!?]$') then 'no_sentence_end'
      when regexp_matches(b[:-2],
        '[.!?]+\\s*(?:It|The|This|That|These|Those|A|An|He|She|They|We|I)(?:[^\\p{L}\\p{N}_]|$)')
        then 'second_sentence' end as reason from bare)
  select image_id, case when reason is null then c end as caption, reason from judged""")
def validate_captions(spark, sf):
    return textjobs.validate_captions(I.caption_lines(spark, sf))


@query("caption_or_default", "caption_lines", """select d.doc_id, coalesce((select arg_max(content, pos)
    from caption_lines c where c.doc_id = d.doc_id and length(content) > 0), 'an object') as caption
  from documents d""")
def caption_or_default(spark, sf):
    lines = I.caption_lines(spark, sf).select(
        F.col("doc_id").alias("image_id"), "pos", F.col("content").alias("caption"))
    ids = I.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"))
    return joins.caption_or_default(ids, lines, "an object").withColumnRenamed("image_id", "doc_id")


_JSON_ANSWERS = """, raw as (select image_id, replace(case source when 'src1' then 'I cannot tell.'
      when 'src2' then '{"yes":"quality","uncertain":[]}'
      when 'src3' then replace(whole, '"yes":[', '"yes":["shiny ","long",')
      when 'src4' then replace(whole, '"yes"', '"present"')
      when 'src5' then whole || ' and {more}' else whole end, ',]', ']') as content
    from (select image_id, source, '```json' || chr(10) || '{"yes":' || case when len(present) = 0 then '[]'
        else '["' || array_to_string(present, '","') || '"]' end || ',"uncertain":' ||
        case when len(uncertain) = 0 then '[]' else '["' || array_to_string(uncertain, '","') || '"]' end
        || '}' || chr(10) || '```' as whole from label_rows)),
  parsed as (select image_id, try_cast(nullif(regexp_extract(regexp_replace(content, '```(?:json)?', '',
      'g'), '(?s)\\{.*\\}'), '') as json) as o from raw),
  fields as (select image_id, o, coalesce(json_extract(o, '$.yes'), json_extract(o, '$.present')) as y,
      json_extract(o, '$.uncertain') as u from parsed),
  lists as (select image_id, o, y, u, case when json_type(y) = 'ARRAY'
      then json_extract_string(y, '$[*]') else [] end as ys,
      case when json_type(u) = 'ARRAY' then json_extract_string(u, '$[*]') else [] end as us from fields),
  judged as (select *, list_sort(list_distinct(list_filter(ys, lambda x: list_contains({n}, x)))) as p,
      list_sort(list_distinct(list_filter(us, lambda x: list_contains({n}, x)
        and not list_contains(ys, x)))) as q,
      list_sort(list_distinct(list_filter(list_transform(list_concat(ys, us), lambda x: trim(x)),
        lambda x: not list_contains({n}, x)))) as k from lists)
  select image_id, case when reason is null then array_to_string(p, ',') end as present,
    case when reason is null then array_to_string(q, ',') end as uncertain,
    case when reason is null then array_to_string(k, ',') end as unknown_names, reason
  from (select *, case when o is null then 'no_json_object'
      when json_type(y) <> 'ARRAY' or json_type(u) <> 'ARRAY' then 'labels_not_lists'
      when len(p) = 0 then 'no_present_label' end as reason from judged)""".replace("{n}", _NAMES)


@query("parse_label_json", "label_rows", _JSON_ANSWERS)
def parse_label_json(spark, sf):
    p = textjobs.parse_label_json(I.label_responses(spark, sf, "json"), NAMES)
    return p.select("image_id", *[F.array_join(c, ",").alias(c) for c in (
        "present", "uncertain", "unknown_names")], "reason")


_CHECKLIST = f"""select image_id, case when reason is null then array_to_string(list_filter({_NAMES},
    lambda n: list_contains(present, n)), ',') end as present, reason
  from (select *, case when source = 'src1' then 'line_count' when source = 'src2' or
    (source = 'src3' and len(present) < {len(NAMES)}) then 'noncanonical_line' end as reason
    from label_rows)"""


@query("parse_named_checklist", "label_rows", _CHECKLIST)
def parse_named_checklist(spark, sf):
    p = textjobs.parse_named_checklist(I.label_responses(spark, sf, "named"), NAMES)
    return p.select("image_id", F.array_join("present", ",").alias("present"), "reason")


@query("parse_numbered_checklist", "label_rows", _CHECKLIST)
def parse_numbered_checklist(spark, sf):
    p = textjobs.parse_numbered_checklist(I.label_responses(spark, sf, "numbered"), NAMES)
    return p.select("image_id", F.array_join("present", ",").alias("present"), "reason")


@query("parse_reject_counts", "label_rows", f"""select coalesce(reason, 'accepted') as outcome,
  count(*) as rows from ({_CHECKLIST}) group by outcome""")
def parse_reject_counts(spark, sf):
    return textjobs.reject_counts(
        textjobs.parse_named_checklist(I.label_responses(spark, sf, "named"), NAMES))


_POLICY = "Mark a concept only when it is clearly visible."


@query("build_label_prompts", "images", f"""select image_id, '{_POLICY}' || chr(10) || chr(10) ||
    'Answer every concept in list order, one line each, exactly as' || chr(10) || 'concept name: YES' ||
    chr(10) || 'or' || chr(10) || 'concept name: NO' || chr(10) || chr(10) || 'Concepts:' || chr(10) ||
    array_to_string(list_transform({_NAMES}, lambda n: '- ' || n), chr(10)) || chr(10) || chr(10) ||
    'The labeled main object is: ' || trim(replace(regexp_replace(class, '\\d+$', ''), '_', ' ')) as prompt
  from images""")
def build_label_prompts(spark, sf):
    from axisframe.functions.columns import subject_label

    rows = I.images(spark, sf).withColumn("object_label", subject_label("image_id"))
    return textjobs.build_label_prompts(rows, NAMES, _POLICY, "named")


@query("tag_phrase_texts", "tags",
       "select distinct phrase, 'an object that is ' || phrase as text from tags")
def tag_phrase_texts(spark, sf):
    from axisframe.functions.columns import phrase_text

    return I.tags(spark, sf).select("phrase").distinct().withColumn("text", phrase_text("phrase"))


@query("extract_embedded_json", "", """select page_id, case when not contains(url, '/fr/')
    then page_id end as page, case when not contains(url, '/fr/') then url end as url from pages""")
def extract_embedded_json(spark, sf):
    found = textjobs.extract_embedded_json(I.embedded_pages(spark, sf), "page long, url string")
    return found.select("page_id", "payload.page", "payload.url")
