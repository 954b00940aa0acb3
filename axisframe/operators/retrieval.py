"""Exact retrieval ranks and the metrics made from them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.functions import columns as C
from axisframe.functions import screening
from axisframe.functions.arrow import matrix
from axisframe.operators.linalg import dense_products, vector_width
from axisframe.operators.ranking import exact_percentiles, join_groups
from axisframe.operators.scalars import with_row
from axisframe.operators.tiles import BLOCK_BYTES, cross_tiles, hashed_block, tile_parallelism
from axisframe.session import materialize

# They must equal the reference's for right results.
TIE_BAND = 1e-7
RECALL_AT = (1, 5, 10, 20, 25, 50)
PAGE_SIZE = 28
MAX_WEIGHT = 3.0
# Scores that differ by rounding only are ties of paired retrieval.
EXACT_TIE = 1e-12
# So many queries of one tile with the same concepts are worth a sort of its scores.
SHARED_PREFIX = 8
# Scores that a task ranks and hands on at once.
RANKED_CELLS = 1 << 20


def gallery_scores(queries: DataFrame, gallery: DataFrame, query_key: str = "query_id",
                   item_key: str = "item_id", vector: str = "embedding") -> DataFrame:
    """``(query, item, score)`` of every query against every gallery row."""
    return dense_products(queries.withColumn(vector, C.as_doubles(vector)),
                          gallery.withColumn(vector, C.as_doubles(vector)),
                          query_key, item_key, vector)


def _least_copies(vectors: np.ndarray, items: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the ``k`` best of a query: of equal vectors those of the ``k`` smallest items."""
    rows = np.ascontiguousarray(vectors)
    alike = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((items, alike.reshape(-1)))
    return np.sort(order[_first_of(alike.reshape(-1)[order], k)])


def _first_of(groups: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first ``k`` of their group; groups stand together."""
    new = np.concatenate(([True], groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, bool)
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(new, at, 0)) < k


def best_pairs(queries: np.ndarray, gallery: np.ndarray, items: np.ndarray, k: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, gallery row, score)`` of the ``k`` best of each query, ties to smaller items.

    A single-precision product finds the pairs that can still be among them; their scores are made exactly.
    """
    items = np.unique(items, return_inverse=True)[1].reshape(-1)
    used = _least_copies(gallery, items, k)
    gallery, items = gallery[used], items[used]
    plain = not screening.usable(queries, gallery)
    a, b = (x if plain else x.astype(np.float32) for x in (queries, gallery))
    norms = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (a, b)]
    parts = []
    for rows in screening.pieces(len(a)):
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(rows.stop - rows.start, -np.inf)
        for columns in screening.pieces(len(b)):
            scores = a[rows] @ b[columns].T
            away = 0.0 if plain else 1e-11 + 2 * screening.rounding(
                scores.shape[1] and b.shape[1], norms[0][rows].max() * norms[1][columns].max())
            limit = least
            if len(b) and scores.shape[1] > k:
                limit = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
            i, j = np.nonzero(scores >= (limit - away)[:, None]) if not plain else map(
                np.ravel, np.indices(scores.shape))
            j = j + columns.start
            exact = np.einsum("ij,ij->i", queries[rows][i], gallery[j])
            i, j, exact = (np.concatenate(x) for x in zip(held, (i, j, exact), strict=True))
            order = np.lexsort((items[j], -np.round(exact, 12), i))
            order = order[_first_of(i[order], k)]
            held = i, j, exact = i[order], j[order], exact[order]
            full = np.bincount(i, minlength=len(least)) == k
            last = np.concatenate((i[1:] != i[:-1], [True])) if len(i) else np.zeros(0, bool)
            least[i[last]] = exact[last]
            least[~full] = -np.inf
        parts.append((held[0] + rows.start, used[held[1]], held[2]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def gallery_top_k(queries: DataFrame, gallery: DataFrame, k: int, query_key: str = "query_id",
                  item_key: str = "item_id", vector: str = "embedding") -> DataFrame:
    """``(query, rank, item, score)``: the ``k`` best gallery rows of every query, ties to smaller items.

    A tile keeps its own ``k`` best, so what leaves the tiles is k rows a query and block.
    """
    q, g = (side.select(F.col(key).alias("id"), C.as_doubles(vector).alias("v"))
            for side, key in ((queries, query_key), (gallery, item_key)))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"q": a.column("id").slice(0, 0), "item": b.column("id").slice(0, 0),
                             "score": pa.array([], pa.float64())})
        row, item, score = best_pairs(matrix(a.column("v")), matrix(b.column("v")), b.column("id").to_numpy(), k)
        return pa.table({"q": a.column("id").take(pa.array(row)), "item": b.column("id").take(pa.array(item)),
                         "score": score})

    schema = T.StructType([T.StructField("q", q.schema["id"].dataType), T.StructField("item", g.schema["id"].dataType),
                           T.StructField("score", T.DoubleType())])
    found = cross_tiles(q, g, "id", "id", vector_width(g, "v"), best, schema, whole=True)
    place = Window.partitionBy("q").orderBy(F.round("score", 12).desc(), "item")
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select(F.col("q").alias(query_key), "rank", F.col("item").alias(item_key), "score"))


def ranked_gallery(queries: DataFrame, gallery: DataFrame, query_key: str = "query_id",
                   item_key: str = "item_id", vector: str = "embedding") -> DataFrame:
    """``(query, rank, item, score)``: every gallery row for every query, best first, ties to smaller items.

    A task ranks its share of the queries against the whole gallery, a few queries at a time, so no pair is
    shuffled. A gallery too large for that is met in tiles and its pairs are ranked by a window.
    """
    q = materialize(queries.select(F.col(query_key).alias("q"), C.as_doubles(vector).alias("v")))
    g = materialize(gallery.select(F.col(item_key).alias("item"), C.as_doubles(vector).alias("v")))
    schema = T.StructType([T.StructField(query_key, q.schema["q"].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField(item_key, g.schema["item"].dataType), T.StructField("score", T.DoubleType())])
    if g.count() * vector_width(g, "v") * 8 > BLOCK_BYTES:
        place = Window.partitionBy("q").orderBy(F.round("score", 12).desc(), "item")
        return dense_products(q, g, "q", "item", "v").select(
            F.col("q").alias(query_key), F.row_number().over(place).alias("rank"), F.col("item").alias(item_key), "score")
    bands = max(1, min(4 * q.sparkSession.sparkContext.defaultParallelism, -(-q.count() // 64)))
    dealt = q.withColumn("_band", hashed_block(F.col("q"), bands)).withColumn("asks", F.lit(True)).unionByName(
        g.withColumn("_band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).withColumn("asks", F.lit(False)),
        allowMissingColumns=True)

    def rank(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asking, held = table.filter(table.column("asks")), table.filter(pc.invert(table.column("asks")))
        if not asking.num_rows or not held.num_rows:
            return
        # In the order of the items, a stable sort leaves ties to the smaller ones.
        held = held.take(pc.sort_indices(held.column("item")))
        a, b, names = matrix(asking.column("v")), matrix(held.column("v")), held.column("item").combine_chunks()
        places = np.arange(1, len(b) + 1, dtype=np.int32)
        for part in screening.pieces(len(a), max(1, RANKED_CELLS // len(b))):
            # A pair's score is summed in one way, wherever the pair stands.
            scores = np.einsum("ik,jk->ij", a[part], b)
            rounded = np.round(scores, 12)
            order = np.argsort(np.where(np.isnan(rounded), -np.inf, -rounded), axis=1, kind="stable")
            asked = np.repeat(np.arange(part.start, part.stop), len(b))
            yield pa.RecordBatch.from_arrays(
                [asking.column("q").combine_chunks().take(pa.array(asked)), pa.array(np.tile(places, len(order))),
                 names.take(pa.array(order.ravel())), pa.array(np.take_along_axis(scores, order, axis=1).ravel())],
                schema.names)

    return (dealt.repartition(tile_parallelism(q, bands), "_band").groupBy("_band").applyInArrow(rank, schema))


# ---- paired retrieval ------------------------------------------------------

def _ahead(scores: np.ndarray, own: np.ndarray, mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many others beat each row's own target in one tile, ties going to smaller indexes."""
    ahead = (scores > own[:, None] + EXACT_TIE) & (other[None, :] != mine[:, None])
    tied = (np.abs(scores - own[:, None]) <= EXACT_TIE) & (other[None, :] < mine[:, None])
    return (ahead | tied).sum(axis=1)


def pair_counts(q: np.ndarray, t: np.ndarray, own_q: np.ndarray, own_t: np.ndarray, at_q: np.ndarray,
                at_t: np.ndarray, both: bool) -> list[np.ndarray]:
    """``_ahead`` of every query among the targets, with ``both`` also of every target among the queries.

    One product in single precision serves both; pairs near a row's own score are multiplied out exactly.
    """
    found = [np.zeros(len(q), np.int64), *([np.zeros(len(t), np.int64)] if both else [])]
    # A repeated position is no rival of itself, whatever it scores: such tiles are compared pair by pair.
    plain = not screening.usable(q, t, own_q, own_t) or len(np.unique(at_q)) < len(q) or len(np.unique(at_t)) < len(t)
    a, b = (x if plain else x.astype(np.float32) for x in (q, t))
    lengths = 0.0 if plain else max(np.sqrt((x ** 2).sum(axis=1).max()) for x in (q, t)) ** 2
    away = EXACT_TIE + screening.rounding(q.shape[1], lengths)
    for rows in screening.pieces(len(q)):
        for columns in screening.pieces(len(t)):
            scores = a[rows] @ b[columns].T
            if plain:
                found[0][rows] += _ahead(scores, own_q[rows], at_q[rows], at_t[columns])
                if both:
                    found[1][columns] += _ahead(scores.T, own_t[columns], at_t[columns], at_q[rows])
                continue
            for out, own, mine, other, split, mine_at, place in [
                    (found[0], own_q, at_q, at_t, screening.split_rows, rows, 0),
                    *([(found[1], own_t, at_t, at_q, screening.split_columns, columns, 1)] if both else [])]:
                above, i, j = split(scores, own[mine_at], away)
                i, j = i + rows.start, j + columns.start
                gap = np.einsum("ij,ij->i", q[i], t[j])
                me, rival = (i, j) if place == 0 else (j, i)
                gap -= own[me]
                ahead = ((gap > EXACT_TIE) & (other[rival] != mine[me])) | (
                    (np.abs(gap) <= EXACT_TIE) & (other[rival] < mine[me]))
                out[mine_at] += above + np.bincount(me[ahead] - mine_at.start, minlength=len(above))
    return found


def _pair_counts(pairs: DataFrame, query: str, target: str, key: str, both: bool) -> DataFrame:
    """``(backward, pos, rank)``. One product serves both directions: a tile's rows rank the
    targets of its queries, its columns the queries of its targets. Only counts leave a tile."""
    q, t = C.l2_normalize(query, guard="strict"), C.l2_normalize(target, guard="strict")
    unit = pairs.select(F.col(key).alias("pos"), q.alias("q"), t.alias("t"))
    unit = unit.select("pos", "q", "t", C.dot("q", "t").alias("own"))
    schema = T.StructType([T.StructField("backward", T.BooleanType()),
                           T.StructField("pos", unit.schema["pos"].dataType),
                           T.StructField("ahead", T.LongType())])

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"backward": pa.array([], pa.bool_()),
                             "pos": a.column("pos").slice(0, 0), "ahead": pa.array([], pa.int64())})
        found = pair_counts(matrix(a.column("q")), matrix(b.column("t")), *[
            x.column(c).to_numpy() for c in ("own", "pos") for x in (a, b)], both)
        return pa.concat_tables([pa.table({
            "backward": pa.array(np.full(x.num_rows, backward)), "pos": x.column("pos"), "ahead": ahead})
            for backward, x, ahead in zip((False, True), (a, b), found)])

    counts = cross_tiles(unit.select("pos", "q", "own"), unit.select("pos", "t", "own"), "pos", "pos",
                         vector_width(unit, "q"), count, schema, whole=True)
    return counts.groupBy("backward", "pos").agg((1 + F.sum("ahead")).alias("rank"))


def target_rank_index_tie(pairs: DataFrame, query: str, target: str, key: str = "pos"
                          ) -> DataFrame:
    """``(pos, rank)`` of each query's own target: 1 + those ahead + ties of smaller index."""
    return _pair_counts(pairs, query, target, key, both=False).select("pos", "rank")


def paired_ranks(pairs: DataFrame, image: str = "image", caption: str = "caption",
                 key: str = "pos") -> DataFrame:
    """``(direction, pos, rank)`` both ways."""
    ranks = _pair_counts(pairs, image, caption, key, both=True)
    return ranks.select(F.when(F.col("backward"), "caption_to_image").otherwise("image_to_caption")
                        .alias("direction"), "pos", "rank")


def paired_retrieval(pairs: DataFrame, ks: Sequence[int] = (1, 5, 10), image: str = "image",
                     caption: str = "caption", key: str = "pos") -> DataFrame:
    """Recall at k, reciprocal rank and mean, median and maximum rank per direction."""
    return rank_summary(paired_ranks(pairs, image, caption, key), ["direction"], ks)


def rank_summary(ranks: DataFrame, by: Sequence[str], ks: Sequence[int]) -> DataFrame:
    ranks = materialize(ranks)
    metrics = ranks.groupBy(*by).agg(
        F.count("*").alias("queries"),
        *[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_at_{k}") for k in ks],
        F.avg(1.0 / F.col("rank")).alias("mean_reciprocal_rank"),
        F.avg("rank").alias("mean_rank"), F.max("rank").alias("maximum_rank"))
    median = exact_percentiles(ranks, by, "rank", {"median_rank": 0.5})
    return join_groups(metrics, median, by)


def quality_gates(checks: DataFrame, metrics: DataFrame, norm_atol: float, max_drop_pp: float,
                  ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """``(gate, value, passed)`` for each normalization and non-inferiority check and overall.

    ``checks`` is ``(label, all_finite, zero_norm_rows, max_abs_error)``; ``metrics`` is
    ``(encoder, direction, recall_at_k...)`` for encoders baseline and candidate.
    """
    normal = checks.select(
        F.concat(F.lit("normalization."), "label").alias("gate"),
        F.col("max_abs_error").alias("value"),
        (F.col("all_finite") & (F.col("zero_norm_rows") == 0)
         & (F.col("max_abs_error") <= norm_atol)).alias("passed"))
    long = metrics.select("encoder", "direction", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"recall_at_{k}").alias("recall")) for k in ks]))
        .alias("r")).select("encoder", "direction", "r.*")
    sides = long.groupBy("direction", "k").agg(
        F.max(F.when(F.col("encoder") == "baseline", F.col("recall"))).alias("b"),
        F.max(F.when(F.col("encoder") == "candidate", F.col("recall"))).alias("c"))
    delta = (F.col("c") - F.col("b")) * 100.0
    recall = sides.select(F.concat("direction", F.lit(".recall_at_"), F.col("k").cast("string"))
                          .alias("gate"), delta.alias("value"),
                          (delta >= -max_drop_pp).alias("passed"))
    each = normal.unionByName(recall)
    least = F.min(F.when(~F.col("gate").startswith("normalization."), F.col("value")))
    overall = each.agg(least.alias("value"), F.every("passed").alias("passed")).select(
        F.lit("overall").alias("gate"), "value", "passed")
    return each.unionByName(overall)


# ---- compositional retrieval -----------------------------------------------

def nested_prefix_scores(rollouts: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(model, image_id, rollout, kind, step, score)``: running sum on the source's own profile.

    Made inside the row, as a rollout has at most the largest query size.
    """
    joined = rollouts.join(profiles, "image_id")
    cells = F.transform(F.sequence(F.lit(1), F.size("seq")), lambda k: F.struct(
        k.alias("step"), F.aggregate(F.slice("seq", F.lit(1), k), F.lit(0.0), lambda t, c:
                                     t + F.element_at("profile", c + 1)).alias("score")))
    return joined.select("model", "image_id", "rollout", "kind", F.explode(cells).alias("s")).select(
        "model", "image_id", "rollout", "kind", "s.step", "s.score")


def _prefix_sums(gallery: np.ndarray, prefix: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Sums in the order of the prefix, as the query's own score was made."""
    total = 0.0 + gallery[prefix[..., 0], at]
    for step in range(1, prefix.shape[-1]):
        total = total + gallery[prefix[..., step], at]
    return total


def prefix_counts(gallery: np.ndarray, prefix: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many gallery rows beat and tie the query's own score, by the sum of the prefix's concepts.

    ``gallery`` has a row per concept. Queries of the same concepts share one sorted list of scores;
    the others are screened in single precision, and pairs close to a limit are summed exactly.
    """
    size = prefix.shape[1]
    greater, equal = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    if not screening.usable(gallery, own):
        for i, concepts in enumerate(prefix):
            gap = _prefix_sums(gallery, concepts) - own[i]
            greater[i], equal[i] = (gap > TIE_BAND).sum(), (np.abs(gap) <= TIE_BAND).sum()
        return greater, equal
    # The sum of two does not depend on their order, that of more may.
    alike, group, times = np.unique(np.sort(prefix, axis=1) if size <= 2 else prefix, axis=0,
                                    return_inverse=True, return_counts=True)
    group = group.reshape(-1)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(times)
    for g in np.flatnonzero(times >= SHARED_PREFIX):
        rows = order[ends[g] - times[g]:ends[g]]
        scores = np.sort(_prefix_sums(gallery, alike[g]))
        above = np.searchsorted(scores, own[rows] + TIE_BAND, "right")
        greater[rows] = len(scores) - above
        equal[rows] = above - np.searchsorted(scores, own[rows] - TIE_BAND, "left")
    rest = np.flatnonzero(times[group] < SHARED_PREFIX)
    single = gallery.astype(np.float32)
    for part in screening.pieces(len(rest)):
        rows = rest[part]
        chosen = np.zeros((len(rows), len(gallery)), np.float32)
        for step in range(size):
            chosen[np.arange(len(rows)), prefix[rows, step]] += 1
        largest = np.abs(own[rows]).max()
        for columns in screening.pieces(gallery.shape[1]):
            away = TIE_BAND + screening.rounding(size, size * np.abs(single[:, columns]).max() + largest)
            above, i, j = screening.split_rows(chosen @ single[:, columns], own[rows], away)
            gap = _prefix_sums(gallery, prefix[rows[i]], j + columns.start) - own[rows[i]]
            greater[rows] += above + np.bincount(i[gap > TIE_BAND], minlength=len(rows))
            equal[rows] += np.bincount(i[np.abs(gap) <= TIE_BAND], minlength=len(rows))
    return greater, equal


def target_rank_avg_tie(rollouts: DataFrame, profiles: DataFrame, schedule: Mapping[int, int]
                        ) -> DataFrame:
    """``(model, image_id, rollout, kind, size, rank)`` of the source image at every size.

    A query is one rollout, and a tile of the gallery serves all its prefix sizes. A sequence shorter
    than a size (a short random draw) counts whole. A tile returns two counts per query and size:
    rank = 1 + greater + (equal - 1) / 2.
    """
    sizes = sorted(schedule)
    longest = sizes[-1]
    own = rollouts.join(profiles, "image_id")
    prefix = F.array(*[F.aggregate(F.slice("seq", 1, size), F.lit(0.0), lambda t, c:
                                   t + F.element_at("profile", c + 1)) for size in sizes])
    padded = F.concat("seq", F.array_repeat(F.lit(0), F.lit(longest) - F.size("seq")))
    queries = own.select(
        "model", "image_id", F.col("rollout").cast("int"), "kind", F.col("length").cast("int"),
        F.size("seq").alias("held"), padded.alias("seq"), prefix.alias("own"),
        F.concat_ws("|", F.col("image_id").cast("string"), F.col("rollout").cast("string"),
                    "kind").alias("query"))
    id_field = T.StructField("image_id", profiles.schema["image_id"].dataType)
    schema = T.StructType([
        id_field, T.StructField("rollout", T.IntegerType()), T.StructField("kind", T.StringType()),
        T.StructField("model", T.StringType()), T.StructField("size", T.IntegerType()),
        T.StructField("greater", T.LongType()), T.StructField("equal", T.LongType())])
    allowed = dict(schedule)

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        if a.num_rows and b.num_rows:
            gallery = matrix(b.column("profile"))
            seq = matrix(a.column("seq")).astype(np.int64)
            own_scores = matrix(a.column("own"))
            length, held = a.column("length").to_numpy(), a.column("held").to_numpy()
            rollout = a.column("rollout").to_numpy()
            # Pieces of rows of like size have a tight bound on their error.
            gallery = np.ascontiguousarray(gallery[np.argsort(np.abs(gallery).max(axis=1))].T)
            for at, size in enumerate(sizes):
                valid = np.flatnonzero((length >= size) & (rollout < allowed[size]))
                if not valid.size:
                    continue
                greater, equal = np.empty((2, valid.size), np.int64)
                summed = np.minimum(held[valid], size)
                for used in np.unique(summed):
                    of, rows = summed == used, valid[summed == used]
                    greater[of], equal[of] = prefix_counts(gallery, seq[rows, :used], own_scores[rows, at])
                take = a.take(pa.array(valid))
                parts.append(pa.table({
                    "image_id": take.column("image_id"), "rollout": take.column("rollout"),
                    "kind": take.column("kind"), "model": take.column("model"),
                    "size": pa.array(np.full(valid.size, size, dtype=np.int32)),
                    "greater": greater, "equal": equal}))
        if parts:
            return pa.concat_tables(parts)
        return pa.table({
            "image_id": a.column("image_id").slice(0, 0), "rollout": pa.array([], pa.int32()),
            "kind": pa.array([], pa.string()), "model": pa.array([], pa.string()),
            "size": pa.array([], pa.int32()), "greater": pa.array([], pa.int64()),
            "equal": pa.array([], pa.int64())})

    counts = cross_tiles(queries, profiles.select("model", "image_id", "profile"), "query",
                         "image_id", vector_width(profiles, "profile"), count, schema, ["model"],
                         whole=True)
    rank = 1 + F.sum("greater") + 0.5 * (F.sum("equal") - 1)
    return counts.groupBy("model", "image_id", "rollout", "kind", "size").agg(rank.alias("rank"))


def compositional_ranks(images: DataFrame, profiles: DataFrame, n_concepts: int,
                        schedule: Mapping[int, int], seed: int, short_draws: bool = False) -> DataFrame:
    """Rollouts of ``(image_id, concepts)`` and their ranks in every model's gallery."""
    from axisframe.operators.sampling import concept_rollouts

    return target_rank_avg_tie(concept_rollouts(images, n_concepts, schedule, seed, short_draws), profiles,
                               schedule)


def recall_curve(ranks: DataFrame, gallery_size: int, ks: Sequence[int] = RECALL_AT) -> DataFrame:
    """Per model, kind and size: cohort, recall, reciprocal, median and normalized rank, chance."""
    by = ["model", "kind", "size"]
    ranks = materialize(ranks)
    per_image = ranks.groupBy(*by, "image_id").agg(
        F.count("*").alias("n"),
        *[F.sum((F.col("rank") <= k).cast("long")).alias(f"h{k}") for k in ks],
        F.sum(1.0 / F.col("rank")).alias("rr"), F.sum("rank").alias("r"))
    n = F.sum("n")
    curve = per_image.groupBy(*by).agg(
        F.count("*").alias("images"), n.alias("queries"),
        *[(F.sum(f"h{k}") / n).alias(f"recall_at_{k}") for k in ks],
        (F.sum("rr") / n).alias("mean_reciprocal_rank"),
        ((F.sum("r") - n) / (n * F.lit(gallery_size - 1))).alias("mean_normalized_rank"))
    chance = [F.lit(k / gallery_size).alias(f"chance_at_{k}") for k in ks]
    median = exact_percentiles(ranks, by, "rank", {"median_rank": 0.5})
    return curve.join(median, by).select("*", *chance)


def rank_change_by_length(ranks: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Share improved, unchanged and worsened, and mean change, between consecutive sizes."""
    index = F.array_position(F.array(*[F.lit(s) for s in sorted(sizes)]), F.col("size"))
    query = Window.partitionBy("model", "kind", "image_id", "rollout").orderBy("size")
    steps = ranks.withColumn("_i", index).select(
        "model", "kind", F.col("size").alias("to_size"), F.lag("size").over(query).alias("from_size"),
        (F.col("_i") - F.lag("_i").over(query)).alias("_gap"),
        (F.col("rank") - F.lag("rank").over(query)).alias("change"))

    def share(condition: Column) -> Column:
        return F.avg(condition.cast("double"))

    return steps.where("_gap = 1").groupBy("model", "kind", "from_size", "to_size").agg(
        F.count("*").alias("n"), share(F.col("change") < 0).alias("improved"),
        share(F.col("change") == 0).alias("unchanged"), share(F.col("change") > 0).alias("worsened"),
        F.avg("change").alias("mean_rank_change"))


def paired_comparison(ranks: DataFrame, reference: str, kind: str = "true") -> DataFrame:
    """How the reference model ranks against each other model on the same queries."""
    keys = ["image_id", "rollout", "size"]
    wanted = ranks.where(F.col("kind") == kind)
    wanted = materialize(wanted)
    ref = wanted.where(F.col("model") == reference).select(*keys, F.col("rank").alias("ref_rank"))
    others = wanted.where(F.col("model") != reference)
    d = F.col("ref_rank") - F.col("rank")
    joined = others.join(ref, keys)
    return joined.groupBy("model", "size").agg(
        F.count("*").alias("n"),
        F.avg((d < 0).cast("double")).alias("reference_better"),
        F.avg((d == 0).cast("double")).alias("same_rank"),
        F.avg((d > 0).cast("double")).alias("reference_worse"),
        F.avg(d).alias("mean_rank_difference"))


# ---- interactive queries ---------------------------------------------------

def additive_query_topk(gallery: DataFrame, weights: Mapping[int, float], limit: int = PAGE_SIZE,
                        vector: str = "profile") -> DataFrame:
    """The gallery rows of highest weighted profile sum; weights are clamped to [0, 3]."""
    used = {k: max(0.0, min(MAX_WEIGHT, w)) for k, w in sorted(weights.items())}
    score = F.lit(0.0)
    for concept, weight in used.items():
        if weight:
            score = score + weight * F.element_at(vector, concept + 1)
    return gallery.select("image_id", score.alias("score")).orderBy(
        F.col("score").desc(), "image_id").limit(limit)


def load_item_as_query(gallery: DataFrame, image_id, limit: int = PAGE_SIZE,
                       vector: str = "profile") -> DataFrame:
    """Use an item's own profile, clamped, as the query: one small row joined to the gallery."""
    item = gallery.where(F.col("image_id") == image_id).select(
        F.transform(vector, lambda x: C.clamp(x, 0.0, MAX_WEIGHT)).alias("w")).head()
    if item is None:
        raise ValueError(f"no such gallery item: {image_id}")
    weights = C.literal_array(float(x) for x in item["w"])
    return gallery.select("image_id", C.dot(vector, weights).alias("score")).orderBy(
        F.col("score").desc(), "image_id").limit(limit)


def top_concepts_per_image(profiles: DataFrame, present: DataFrame, k: int = 3,
                           vector: str = "profile") -> DataFrame:
    """``(image_id, place, concept_idx, score)``: best concepts among those present.

    ``present`` is ``(image_id, concepts)``. The order is made inside the row.
    """
    joined = profiles.join(present.select("image_id", "concepts"), "image_id")
    cells = F.transform("concepts", lambda c: F.struct(
        (-F.element_at(vector, c + 1)).alias("neg"), c.alias("concept_idx")))
    best = F.slice(F.array_sort(cells), 1, k)
    return joined.select("image_id", F.posexplode(best).alias("p", "s")).select(
        "image_id", (F.col("p") + 1).cast("long").alias("place"), "s.concept_idx",
        (-F.col("s.neg")).alias("score"))


def caption_retrieval_eval(pairs: DataFrame, scores: DataFrame, ks: Sequence[int] = (1, 5, 10),
                           key: str = "pos") -> DataFrame:
    """One row: image-to-text recall, mean AUROC of concept projections, direction overlap.

    ``pairs`` is ``(pos, image, caption)``; ``scores`` is ``(pos, image, scores)``.
    """
    from axisframe.operators.directions import (
        concept_auroc, group_mean_directions, orthogonality_metrics)
    from axisframe.operators.linalg import project_scores

    ranks = target_rank_index_tie(pairs, "image", "caption", key)
    recall = ranks.agg(*[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_at_{k}")
                         for k in ks])
    directions = materialize(group_mean_directions(scores, "image", "scores"))
    projected = project_scores(scores, directions, "image", "projection", key)
    cells = projected.select(F.posexplode(F.arrays_zip("projection", "scores"))
                             .alias("concept_idx", "c")).select(
        "concept_idx", F.col("c.projection").alias("value"),
        (F.col("c.scores") >= 0.5).alias("positive"))
    auroc = concept_auroc(cells).agg(F.avg("auroc").alias("auroc"))
    overlap = orthogonality_metrics(directions).select(
        F.col("orth_rms").alias("group_mean_orth_rms"))
    return with_row(with_row(recall, auroc), overlap)
