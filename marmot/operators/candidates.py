"""First-stage candidates: scoring, filters, exclusions, per-key top-k."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marmot import schemas as S
from marmot.functions import columns as C
from marmot.session import written


def request_items(requests: DataFrame, item: str = "item_idx") -> DataFrame:
    """One row per (request, available item); duplicates inside a list collapse.

    The planner takes an exploded list for one row, so joins with these rows name their strategy: else
    all of them would pass the driver as a broadcast."""
    keep = [c for c in requests.columns if c != "available_items"]
    return (requests.select(*keep, F.explode(F.array_distinct("available_items")).alias(item)))


LIST = "available_items"


def score_pairs(pairs: DataFrame, user_vecs: DataFrame, item_vecs: DataFrame, user: str = "user_idx",
                item: str = "item_idx", out: str = "score", metric: str = "dot") -> DataFrame:
    """Score only the given (user, item) pairs: two equi-joins, then a codegen'd dot product.

    Pairs without a user or item vector are dropped (the item is unknown to the model).  Rows that still
    have their list of available items are scored as lists (``scored_lists``) and come out one per item.
    """
    if LIST in pairs.columns:
        lists = scored_lists(pairs, user_vecs, item_vecs, user, item, metric)
        rows = lists.select("_row", F.explode(F.arrays_zip("_items", "_scores")).alias("_x"))
        return rows.select("_row.*", F.col("_x._items").alias(item), F.col("_x._scores").alias(out))
    uv = user_vecs.select(F.col(user).alias("_u"), F.col(user_vecs.columns[1]).alias("_uv"))
    iv = item_vecs.select(F.col(item).alias("_i"), F.col(item_vecs.columns[1]).alias("_iv"))
    j = pairs.join(uv.hint("merge"), pairs[user] == uv["_u"]).join(iv.hint("merge"), F.col(item) == iv["_i"])
    expr = C.dot("_uv", "_iv") if metric == "dot" else C.cosine("_uv", "_iv")
    return j.withColumn(out, expr).drop("_u", "_uv", "_i", "_iv")


#: items of a chunk, (request, item) pairs of a task, and requests of a block, of ``scored_lists``
LIST_CHUNK, LIST_PAIRS, BLOCK_REQUESTS = 131_072, 4_000_000, 8192
#: most tasks that the (block, chunk) cells are dealt to
MOST_TASKS = 4000


def scored_lists(requests: DataFrame, user_vecs: DataFrame, item_vecs: DataFrame, user: str = "user_idx",
                 item: str = "item_idx", metric: str = "dot", allowed: DataFrame | None = None,
                 req_category: str = "category_id", exclude_pairs: DataFrame | None = None,
                 attach: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    """Scores of every request's available items, as lists: a vector never travels with each pair.

    Requests are dealt to blocks and, where a block asks for more than about LIST_CHUNK items, items to chunks by a
    hash and a request's list is cut by chunk; every (block, chunk) is one cogrouped task that sums each pair's
    products in order, as ``columns.dot`` does.
    Output: _row (the request's other columns), _items, _scores and a list for every column of ``attach``
    beside its item; a request has one row for each chunk that holds items of it.

    Blocks hold requests of like lists (the range of a list's least hash), and an item goes only to the blocks that
    ask for it.  If the lists have so little in common that this would send more vectors, requests are dealt by a hash
    and the items go to every block, in as few blocks as tasks can hold.

    ``allowed`` (item, category): items outside it are dropped, and so are items without the request's category if it
    names one.  ``exclude_pairs`` (user, item) are taken off the lists first.  Pairs without a vector drop out.
    ``user_vecs`` None: every user has the vector (1), also null.
    """
    return _dealt_lists(requests, user_vecs, item_vecs, user, item, metric, allowed, req_category, exclude_pairs, attach, distinct)[0]


def _dealt_lists(requests: DataFrame, user_vecs: DataFrame | None, item_vecs: DataFrame, user: str, item: str, metric: str,
                 allowed: DataFrame | None, req_category: str, exclude_pairs: DataFrame | None, attach: DataFrame | None,
                 distinct: bool) -> tuple[DataFrame, DataFrame, int]:
    """(``scored_lists``, the written lists with their _row, the number of chunks)."""
    spark = requests.sparkSession
    keep = [c for c in requests.columns if c != LIST]
    items = F.filter(F.array_distinct(LIST) if distinct else F.col(LIST), lambda x: x.isNotNull())
    category = F.col(req_category) if allowed is not None else F.lit(None).cast("int")
    lists = requests.select(F.struct(*keep).alias("_row"), F.col(user).alias("_u"), category.alias("_q"), items.alias("_items"))
    if exclude_pairs is not None:
        gone = exclude_pairs.select(*[F.col(c).alias(n) for c, n in zip(exclude_pairs.columns, ("_u", "_x"))])
        gone = gone.where("_u is not null and _x is not null").groupBy("_u").agg(F.collect_set("_x").alias("_x"))
        lists = lists.join(gone.hint("merge"), "_u", "left")
        lists = lists.withColumn("_items", F.when(F.col("_x").isNull(), F.col("_items")).otherwise(F.array_except("_items", "_x"))).drop("_x")
    if user_vecs is None:
        lists = lists.withColumn("_uv", F.array(F.lit(1.0)))
    else:
        uv = user_vecs.select(F.col(user).alias("_u"), F.col(user_vecs.columns[1]).alias("_uv"))
        lists = lists.join(uv.hint("merge"), "_u")
    side = item_vecs.select(F.col(item).alias("_item"), F.col(item_vecs.columns[1]).alias("_iv"))
    if allowed is not None:
        cats = allowed.select(F.col(allowed.columns[0]).alias("_item"), F.col(allowed.columns[1]).alias("_q"))
        side = side.join(cats.groupBy("_item").agg(F.collect_set("_q").alias("_cats")).hint("merge"), "_item")
    else:
        side = side.withColumn("_cats", F.array().cast("array<int>"))
    extra = [c for c in attach.columns if c != item] if attach is not None else []
    if extra:
        side = side.join(attach.select(F.col(item).alias("_item"), *extra).hint("merge"), "_item")

    # like lists side by side; written once, as the sizes of the blocks and the lists themselves are read from it
    cores = spark.sparkContext.defaultParallelism
    blocks = max(2 * cores, math.ceil(requests.count() / BLOCK_REQUESTS))
    near = F.array_min(F.transform("_items", lambda x: F.xxhash64(x)))
    lists = lists.where(F.size("_items") > 0).select("_row", "_q", "_uv", "_items")
    lists = lists.repartitionByRange(blocks, near, F.xxhash64("_row")).withColumn("_b", F.spark_partition_id())
    dealt = written(lists.sortWithinPartitions("_b", near), "lists")  # equal ones in a row take little room, also when shuffled again
    asked = dealt.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_items").cast("bigint")).alias("pairs")).first()
    n, pairs, n_items = asked["n"], asked["pairs"] or 0, item_vecs.count()
    split = max(1, math.ceil(pairs / blocks / LIST_PAIRS))
    all_chunks = max(1, math.ceil(n_items / LIST_CHUNK))
    all_blocks = max(math.ceil(pairs / all_chunks / LIST_PAIRS), math.ceil(n / LIST_CHUNK), math.ceil(min(cores, n) / all_chunks), 1)
    placed = dealt.withColumn("_b", F.col("_b") * split + F.pmod(F.xxhash64("_row"), F.lit(split)).cast("int"))
    near_blocks = _items_sent(dealt, blocks) * split <= n_items * all_blocks + n * all_chunks
    if near_blocks:
        wanted = written(placed.select("_b", F.explode("_items").alias("_item")).distinct(), "asked-items")
        most = wanted.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        chunks = max(1, math.ceil((most or 0) / LIST_CHUNK))
        side = side.join(wanted.hint("merge"), "_item")
    else:
        chunks = all_chunks
        placed = dealt.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(all_blocks)).cast("int"))
        side = side.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(all_blocks - 1))))
    chunk_of = lambda x: F.pmod(F.xxhash64(x), F.lit(chunks)).cast("int")
    side = side.withColumn("_c", chunk_of(F.col("_item")))
    if chunks == 1:
        parts = placed.withColumn("_c", F.lit(0))
    else:
        placed = placed.withColumn("_at", F.transform("_items", chunk_of)).select("_row", "_q", "_uv", "_b", "_items", "_at")
        parts = placed.mapInArrow(_cut_lists, T.StructType([f for f in placed.schema.fields if f.name != "_at"] + [T.StructField("_c", T.IntegerType())]))
    schema = T.StructType([T.StructField("_row", dealt.schema["_row"].dataType), T.StructField("_items", T.ArrayType(side.schema["_item"].dataType)),
                           T.StructField("_scores", T.ArrayType(T.DoubleType()))] + [T.StructField(c, T.ArrayType(side.schema[c].dataType)) for c in extra])
    # adaptive execution would join cells by their bytes, which are few for like lists, however many pairs they hold
    cells = chunks * (blocks * split if near_blocks else all_blocks)
    tasks = min(max(cells, min(4 * cells, 1000)), MOST_TASKS)
    parts, side = (x.repartition(tasks, "_b", "_c") for x in (parts, side))
    scored = parts.groupBy("_b", "_c").cogroup(side.groupBy("_b", "_c")).applyInArrow(_list_scorer(metric, allowed is not None, extra), schema)
    return scored, dealt, chunks


def _items_sent(dealt: DataFrame, blocks: int, looked: int = 16) -> float:
    """About how many items go to blocks if each gets those that its lists (_b, _items) hold, as some of the blocks tell.

    Decides only how requests are dealt, never what is scored."""
    some = dealt.where(F.col("_b") % max(1, blocks // looked) == 0)
    per = some.select("_b", F.explode("_items").alias("_item")).groupBy("_b").agg(F.approx_count_distinct("_item").alias("n"))
    return (per.agg(F.avg("n")).first()[0] or 0.0) * blocks


def _cut_lists(batches):
    """Lists of items cut by the chunk of each item: one row for every (request, chunk)."""
    import numpy as np
    import pyarrow as pa
    for batch in batches:
        items, at = batch.column("_items"), batch.column("_at")
        n = np.diff(items.offsets.to_numpy())
        owner, chunk = np.repeat(np.arange(batch.num_rows), n), at.flatten().to_numpy()
        order = np.lexsort((chunk, owner))
        owner, chunk = owner[order], chunk[order]
        first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(chunk, prepend=-1) != 0))
        out = {c: batch.column(c).take(pa.array(owner[first])) for c in batch.schema.names if c not in ("_items", "_at")}
        cut = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), items.flatten().take(pa.array(order)))
        yield pa.RecordBatch.from_pydict({**{c: out[c] for c in ("_row", "_q", "_uv", "_b")}, "_items": cut, "_c": pa.array(chunk[first])})


def _vectors_by_dimension(column):
    """(values, dimension first; lengths; whole): vectors of a list column as columns of a matrix.  One with a null in it is not whole."""
    import numpy as np
    import pyarrow.compute as pc
    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(length)), length)
    if flat.null_count:
        whole[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = False
        flat = flat.fill_null(0)
    values = np.zeros((int(length.max(initial=0)), len(length)))
    values[np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length), owner] = flat.to_numpy(zero_copy_only=False)
    return values, length, whole


def _list_scorer(metric: str, by_category: bool, extra: list[str], slab: int = 1 << 18):
    def run(left, right):
        import numpy as np
        import pyarrow as pa
        left, right = left.combine_chunks(), right.combine_chunks()
        one = lambda t, c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
        ids = one(right, "_item").to_numpy(zero_copy_only=False)
        by = np.argsort(ids, kind="stable")
        ids = ids[by]
        lists = one(left, "_items")
        n = np.diff(lists.offsets.to_numpy())
        owner, wanted = np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False)
        low = np.searchsorted(ids, wanted, "left")
        found = np.searchsorted(ids, wanted, "right") - low  # an item with several vectors is several pairs
        pair = np.repeat(np.arange(len(wanted)), found)
        place = by[low[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(found) - found, found)]
        owner = owner[pair]
        if by_category:
            cats = one(right, "_cats")
            many = np.diff(cats.offsets.to_numpy())
            names, code = np.unique(cats.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            of_item = np.repeat(np.arange(len(many)), many) * (len(names) + 1) + code
            asked = one(left, "_q")
            free = asked.is_null().to_numpy(zero_copy_only=False)
            asked = asked.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(names, asked)
            known = (at < len(names)) & (names[np.minimum(at, max(0, len(names) - 1))] == asked) if len(names) else np.zeros(len(asked), bool)
            ok = free[owner] | (known[owner] & np.isin(place * (len(names) + 1) + at[owner], of_item))
            owner, place = owner[ok], place[ok]
        q, q_length, q_whole = _vectors_by_dimension(one(left, "_uv"))
        x, x_length, x_whole = _vectors_by_dimension(one(right, "_iv"))
        score = np.zeros(len(owner))
        dims = min(len(q), len(x))
        norms = [np.sqrt(np.add.reduce(m * m, axis=0)) for m in (q, x)] if metric == "cosine" else None
        for a in range(0, len(owner), slab):
            o, p, total = owner[a:a + slab], place[a:a + slab], score[a:a + slab]
            for d in range(dims):
                total += q[d][o] * x[d][p]
            if norms:
                den = norms[0][o] * norms[1][p]
                total[:] = np.where(den == 0, 0.0, total / np.where(den == 0, 1.0, den))
        null = ~(q_whole[owner] & x_whole[place] & (q_length[owner] == x_length[place]))
        has = np.flatnonzero(np.bincount(owner, minlength=len(n)))
        cuts = pa.array(np.append(np.searchsorted(owner, has), len(owner)).astype(np.int32))
        gathered = lambda values: pa.ListArray.from_arrays(cuts, values)
        at = pa.array(place)
        return pa.table({"_row": one(left, "_row").take(pa.array(has)), "_items": gathered(one(right, "_item").take(at)),
                         "_scores": gathered(pa.array(score, mask=null)), **{c: gathered(one(right, c).take(at)) for c in extra}})
    return run


def exclude_purchased(cands: DataFrame, interactions: DataFrame, user: str = "user_idx", item: str = "item_idx",
                      weight: str = "weight", purchase_weight: float = S.PURCHASE_WEIGHT) -> DataFrame:
    """Drop candidates the user bought (an interaction with the purchase weight).  Anti-join;
    AQE splits skewed (popular-item) partitions."""
    bought = (interactions.where(F.col(weight) == purchase_weight)
              .select(F.col(user).alias("_pu"), F.col(item).alias("_pi")).distinct())
    return cands.join(bought.hint("merge"), (cands[user] == bought["_pu"]) & (cands[item] == bought["_pi"]), "left_anti")


def exclude_seen(cands: DataFrame, interactions: DataFrame, user: str = "user_idx", item: str = "item_idx") -> DataFrame:
    """Drop every candidate the user touched."""
    seen = interactions.select(F.col(user).alias("_su"), F.col(item).alias("_si")).distinct()
    return cands.join(seen.hint("merge"), (cands[user] == seen["_su"]) & (cands[item] == seen["_si"]), "left_anti")


def exclude(cands: DataFrame, interactions: DataFrame, mode: str = "purchased", **kw) -> DataFrame:
    if mode == "purchased":
        return exclude_purchased(cands, interactions, **kw)
    if mode == "seen":
        return exclude_seen(cands, interactions, **kw)
    return cands


def top_k(scored: DataFrame, k: int, by: str | list[str] = "request_id", score: str = "score",
          item: str = "item_idx", rank: str = "rank") -> DataFrame:
    """Per-key top k (score desc, item asc): ``row_number() <= k`` plans a WindowGroupLimit."""
    keys = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(item))
    return scored.withColumn(rank, F.row_number().over(w).cast("int")).where(F.col(rank) <= k)


def category_items(interactions: DataFrame, item: str = "item_idx", category: str = "category_idx") -> DataFrame:
    """(item, category) pairs seen in the interactions (the category filter's item sets)."""
    return interactions.select(item, category).where(F.col(category).isNotNull()).distinct()


def restrict_category(cands: DataFrame, cat_items: DataFrame, req_category: str = "category_id",
                      item: str = "item_idx") -> DataFrame:
    """Keep candidates whose item belongs to the request's category (no category -> keep all)."""
    ci = cat_items.select(F.col(item).alias("_ci"), F.col(cat_items.columns[1]).alias("_cc"))
    hit = cands.join(ci.hint("merge"), (cands[item] == ci["_ci"]) & (cands[req_category] == ci["_cc"]), "left_semi")
    return cands.where(F.col(req_category).isNull()).unionByName(hit)


def _excluded(interactions: DataFrame, mode: str, user: str = "user_idx", item: str = "item_idx") -> DataFrame | None:
    """The (user, item) pairs that a mode of ``exclude`` drops."""
    if mode == "purchased":
        return interactions.where(F.col("weight") == S.PURCHASE_WEIGHT).select(user, item)
    return interactions.select(user, item) if mode == "seen" else None


def mf_top_k(req_items: DataFrame, interactions: DataFrame, user_vecs: DataFrame, item_vecs: DataFrame,
             k: int = S.CANDIDATE_K, exclude_mode: str = "purchased", user: str = "user_id",
             item: str = "item_idx", items: DataFrame | None = None, attach: DataFrame | None = None,
             by_request: bool = False) -> DataFrame:
    """Known-user candidates per request: available items that the model knows (in the
    interactions and with a vector) -> category filter -> purchase/seen exclusion ->
    dot-product score -> top k.  Filters run before scoring, so only surviving pairs are scored.

    ``req_items`` are requests with their list of available items, or one row per (request, item) of
    ``request_items``.  Lists are filtered, scored and cut as lists (``scored_lists``); only the top
    k of each become rows.

    ``items`` (one row per item with its category, e.g. ``serve.item_table``)
    lets a caller share one per-item aggregation across stages; by default the
    (item, category) pairs of the interactions are used.  ``attach`` (one row per item) adds its columns
    to the candidates; items that it lacks drop out.  ``by_request`` deals the rows by request_id, for a window that follows.
    """
    allowed = items.select(item, "category_idx") if items is not None else category_items(interactions, item)
    allowed = allowed.where(F.col(item).isNotNull())
    gone = _excluded(interactions, exclude_mode, item=item)
    given = LIST in req_items.columns
    if not given:  # pairs may repeat, which lists taken off as sets would lose
        pairs = exclude(req_items.withColumnRenamed(user, "user_idx"), interactions, exclude_mode, item=item) if gone is not None else req_items
        keep = [c for c in req_items.columns if c != item]
        req_items = pairs.withColumnRenamed("user_idx", user).groupBy(*keep).agg(F.collect_list(item).alias(LIST))
    return _best_of_lists(req_items, user_vecs.withColumnRenamed(user_vecs.columns[0], user), item_vecs, k, "mf_score", "mf_rank", user, item,
                          allowed=allowed, exclude_pairs=gone if given else None, attach=attach, distinct=given, by_request=by_request)


def _best_of_lists(requests: DataFrame, user_vecs: DataFrame | None, item_vecs: DataFrame, k: int, score: str, rank: str, user: str, item: str,
                   allowed: DataFrame | None = None, exclude_pairs: DataFrame | None = None, attach: DataFrame | None = None,
                   distinct: bool = True, by_request: bool = False) -> DataFrame:
    """The top ``k`` of every request_id, by score (desc), then item, from ``scored_lists``.

    A request whose list was not cut and whose id is its own is ranked where it was scored; else the parts of an id
    are gathered first.  ``by_request`` gathers them anyway, which deals the rows by request_id."""
    keep = [c for c in requests.columns if c != LIST]
    scored, dealt, chunks = _dealt_lists(requests, user_vecs, item_vecs, user, item, "dot", allowed, "category_id", exclude_pairs, attach, distinct)
    extra = [c for c in attach.columns if c != item] if attach is not None else []
    whole = chunks == 1 and not by_request and not dealt.groupBy("_row.request_id").count().where("count > 1").limit(1).count()
    if whole:
        gathered = scored.select(F.col("_row.request_id").alias("_request"), F.array(F.struct(*scored.columns)).alias("_parts"))
    else:
        gathered = scored.groupBy(F.col("_row.request_id").alias("_request")).agg(F.collect_list(F.struct(*scored.columns)).alias("_parts"))

    names = ["_items", "_scores", *extra]

    def pairs_of(part: Column) -> Column:
        """The pairs of a part behind what they sort by: score desc (NaN first, null last), item asc."""
        at = F.sequence(F.lit(0), F.size(part["_items"]) - 1)
        get = lambda c, j: F.get(part[c], j)
        return F.transform(at, lambda j: F.struct(
            get("_scores", j).isNull().alias("a"), (~F.isnan(F.coalesce(get("_scores", j), F.lit(0.0)))).alias("b"),
            (-get("_scores", j)).alias("c"), *[get(c, j).alias(f"v{n}") for n, c in enumerate(names)], part["_row"].alias("r")))

    best = F.slice(F.sort_array(F.flatten(F.transform("_parts", pairs_of))), 1, k)
    rows = gathered.select("_request", F.posexplode(best).alias("_n", "_x"))
    return rows.select(*[F.col("_request").alias(c) if c == "request_id" else F.col(f"_x.r.{c}").alias(c) for c in keep],
                       F.col("_x.v0").alias(item), F.col("_x.v1").alias(score), *[F.col(f"_x.v{n + 2}").alias(c) for n, c in enumerate(extra)],
                       (F.col("_n") + 1).cast("int").alias(rank))


def popular_of_lists(requests: DataFrame, items: DataFrame, k: int, item: str = "item_idx") -> DataFrame:
    """The ``k`` available items of the largest ``popularity_score`` per request, of its category if it names one.

    ``items`` has one row per item (``serve.item_table``).  The score is the item's vector, so lists are cut as in ``mf_top_k``."""
    vecs = items.select(item, F.array("popularity_score").alias("embedding"))
    return _best_of_lists(requests, None, vecs, k, "popularity_score", "position", "user_id", item,
                          allowed=items.select(item, "category_idx"), attach=items.select(item, "category_idx"))


def popular_candidates(requests: DataFrame, interactions: DataFrame, k: int = S.CANDIDATE_K, item: str = "item_idx",
                       category: str = "category_idx", req_category: str = "category_id") -> DataFrame:
    """Candidates for users the model does not know: per request the ``k`` items of the largest weight sum, over the
    rows of its category if it names one (ties by item).  The request's available items play no part here.

    The sums are one aggregate by (item, category); the lists have ``k`` rows per category and ``k`` over all."""
    per = (interactions.where(F.col(item).isNotNull()).groupBy(item, category)
           .agg(F.coalesce(F.sum("weight"), F.lit(0.0)).cast("double").alias("mf_score")))
    of_category = top_k(per.where(F.col(category).isNotNull()), k, category, "mf_score", item, "mf_rank")
    overall = per.groupBy(item).agg(F.sum("mf_score").alias("mf_score")).orderBy(F.col("mf_score").desc(), F.col(item)).limit(k)
    # the window without a key runs over k rows
    overall = overall.withColumn("mf_rank", F.row_number().over(Window.orderBy(F.col("mf_score").desc(), F.col(item))).cast("int"))
    lists = of_category.unionByName(overall.withColumn(category, F.lit(None).cast(per.schema[category].dataType)))
    lists = lists.select(F.col(category).alias("_c"), item, "mf_score", "mf_rank")
    return requests.join(F.broadcast(lists), requests[req_category].eqNullSafe(lists["_c"])).drop("_c")


def mf_candidates(routed: DataFrame, interactions: DataFrame, user_vecs: DataFrame, item_vecs: DataFrame,
                  k: int = S.CANDIDATE_K, exclude_mode: str = "purchased") -> DataFrame:
    """First-stage candidates of every request of ``serve.route``: the model's top ``k`` where it knows the user, else
    the most popular items by weight sum.  Columns request_id, item_idx, mf_score, mf_rank."""
    out = ("request_id", "item_idx", "mf_score", "mf_rank")
    known = mf_top_k(routed.where("known"), interactions, user_vecs, item_vecs, k, exclude_mode)
    return known.select(*out).unionByName(popular_candidates(routed.where(~F.col("known")), interactions, k).select(*out))


# --------------------------------------------------------------------------- all-items top-k
def _normalize(M):
    import numpy as np
    n = np.linalg.norm(M, axis=1, keepdims=True)
    return np.divide(M, n, out=np.zeros_like(M), where=n > 0)


def _top_rows(Q, X, ids, qids, exl, k, min_score, slab=512):
    """Exact top-k of Q @ X.T per query row, ties broken by item id ascending.

    Scores are computed in slabs of ``slab`` queries (bounded memory);
    excluded items and scores not above ``min_score`` are removed before the
    cut.  Returns arrays (query, item, score, rank).
    """
    import numpy as np
    import pandas as pd
    pos = pd.Index(ids)
    kk = min(k, X.shape[0])
    out_q, out_i, out_s, out_r = [], [], [], []
    for lo in range(0, Q.shape[0], slab):
        S = Q[lo:lo + slab] @ X.T
        if min_score is not None:
            S = np.where(S > min_score, S, -np.inf)
        if exl is not None:
            for r, lst in enumerate(exl[lo:lo + slab]):
                if lst is not None and len(lst):
                    cols = pos.get_indexer(np.asarray(lst))
                    S[r, cols[cols >= 0]] = -np.inf
        idx = np.argpartition(-S, kk - 1, axis=1)[:, :kk]
        top = np.take_along_axis(S, idx, axis=1)
        kth = top.min(axis=1)
        ties = np.nonzero((S >= kth[:, None]).sum(axis=1) > kk)[0]
        for r in ties:  # rare: equal scores straddle the cut -> smallest item ids win
            cand = np.nonzero(S[r] >= kth[r])[0]
            idx[r] = cand[np.lexsort((ids[cand], -S[r, cand]))[:kk]]
        top = np.take_along_axis(S, idx, axis=1)
        sel = ids[idx]
        order = np.lexsort((sel, -top), axis=1)
        sel, top = np.take_along_axis(sel, order, axis=1), np.take_along_axis(top, order, axis=1)
        b = sel.shape[0]
        out_q.append(np.repeat(qids[lo:lo + b], kk))
        out_i.append(sel.ravel())
        out_s.append(top.ravel())
        out_r.append(np.tile(np.arange(1, kk + 1, dtype=np.int32), b))
    q, i, sc, rk = (np.concatenate(a) for a in (out_q, out_i, out_s, out_r))
    ok = np.isfinite(sc)
    return q[ok], i[ok], sc[ok], rk[ok]


#: bands of item norms that the driver knows the counts and maxima of
MAX_BANDS = 256


@dataclass(frozen=True)
class Band:
    """Items of one range of norms: the largest norm, the number of its first chunk, how many chunks it has."""
    max_norm: float
    first: int
    chunks: int
    rows: int


def norm_bands(items: DataFrame, norm: str, item_block: int) -> tuple[list[float], list[Band]]:
    """(cuts, bands) of an item table by falling norm; band b holds the items below b of the cuts.

    Approximate quantiles cut the norms into about one band for ``item_block`` items (at most MAX_BANDS);
    a band of more items, such as one of equal norms, has several chunks by hash.
    """
    n = items.count()
    if not n:
        return [], []
    wanted = min(MAX_BANDS, math.ceil(n / item_block))
    cuts: list[float] = []
    if wanted > 1:
        found = items.agg(F.percentile_approx(norm, [b / wanted for b in range(1, wanted)], 10_000)).first()[0]
        cuts = sorted(set(found), reverse=True)
    bands, first = [], 0
    stats = {r["b"]: r for r in items.groupBy(_band_of(F.col(norm), cuts).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).collect()}
    for b in range(len(cuts) + 1):
        rows = stats[b]["n"] if b in stats else 0
        bands.append(Band(float(stats[b]["m"]) if rows else 0.0, first, math.ceil(rows / item_block), rows))
        first += bands[-1].chunks
    return cuts, bands


def _band_of(norm: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > norm)) if cuts else F.lit(0)


def open_bands(norm: Column, kth: Column, bands: list[Band], start: int, min_score: float | None = None) -> Column:
    """The bands from ``start`` on that may still hold a better item: by Cauchy-Schwarz no score exceeds
    the query's norm times the band's largest norm.  ``kth`` is the score to beat or to tie; null opens all."""
    def reaches(bound: Column) -> Column:
        top = bound * norm * F.lit(1.0 + 1e-9)  # room for rounding
        fine = kth.isNull() | (top >= kth)
        return fine if min_score is None else fine & (top > F.lit(min_score))
    numbered = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(bands[b].max_norm).alias("m")) for b in range(start, len(bands)) if bands[b].rows])
    return F.transform(F.filter(numbered, lambda x: reaches(x["m"])), lambda x: x["b"])


def blocked_top_k(queries: DataFrame, items: DataFrame, k: int, metric: str = "dot", min_score: float | None = None,
                  query_block: int = 65536, item_block: int = 16384, key: str = "user_idx",
                  item: str = "item_idx", exclude_pairs: DataFrame | None = None) -> DataFrame:
    """Exact top-k items per query vector over the whole item table, never emitting
    query x item rows.  Ties are broken by item id (as ``top_k`` does).

    Queries are hashed into blocks of at most about ``query_block`` (as many blocks as
    the cluster runs tasks, at least) and items into chunks of about ``item_block`` by falling
    norm; every (block, chunk) pair is one cogrouped pandas task that keeps k per
    query and chunk, and a window keeps the best k over chunks.  Per-task memory is bounded
    by the block sizes; nothing of the item table reaches the driver.

    The chunks of the largest norms are scored first.  A query then goes only to chunks whose
    largest norm, times its own, can reach its k-th score so far; items go only to blocks that
    ask for their chunk.  Cosines have no such bound (all norms are one): every chunk is scored at once.

    ``exclude_pairs`` (key, item) are removed inside the task before the cut, so no
    over-fetch is needed: each query row carries its excluded items of that chunk.
    """
    cosine = metric == "cosine"
    qv = queries.select(F.col(key).alias("q"), F.col(queries.columns[1]).alias("qv"))
    iv = items.select(F.col(item).alias("i"), F.col(items.columns[1]).alias("iv"))
    iv = iv.withColumn("nn", F.lit(1.0) if cosine else C.l2_norm("iv"))
    q_type, i_type = qv.schema["q"].dataType, iv.schema["i"].dataType
    out_schema = T.StructType([T.StructField("q", q_type), T.StructField("i", i_type),
                               T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    spark = qv.sparkSession
    cuts, bands = norm_bands(iv, "nn", item_block)
    if not bands:
        return spark.createDataFrame([], out_schema).select(F.col("q").alias(key), F.col("i").alias(item), "score", "rank")
    # the first bands: enough items for k after exclusions, as a rule
    start, have = 0, 0
    while start < len(bands) and (cosine or have < max(item_block, 8 * k)):
        have += bands[start].rows
        start += 1
    first = F.array(*[F.lit(b.first) for b in bands])
    parts = F.array(*[F.lit(max(1, b.chunks)) for b in bands])
    band = _band_of(F.col("nn"), cuts)
    placed = iv.select("i", "iv", (F.get(first, band) + F.pmod(F.xxhash64("i"), F.get(parts, band))).cast("int").alias("ic"))
    chunks_of = F.array(*[F.sequence(F.lit(b.first), F.lit(b.first + max(1, b.chunks) - 1)) for b in bands])
    n_q = max(spark.sparkContext.defaultParallelism, math.ceil(qv.count() / query_block))
    qv = qv.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(n_q)).cast("int"))
    ex = None
    if exclude_pairs is not None:
        ex = (exclude_pairs.select(F.col(key).alias("q"), F.col(item).alias("_x")).distinct()
              .join(placed.select(F.col("i").alias("_x"), "ic"), "_x").groupBy("q", "ic").agg(F.collect_list("_x").alias("ex")))

    def block(qpdf, ipdf):
        import numpy as np
        import pandas as pd
        if qpdf.empty or ipdf.empty:
            return pd.DataFrame({"q": [], "i": [], "score": [], "rank": []})
        Q = np.vstack(qpdf["qv"].to_numpy()).astype(np.float64)
        X = np.vstack(ipdf["iv"].to_numpy()).astype(np.float64)
        if cosine:
            Q, X = _normalize(Q), _normalize(X)
        q, i, sc, rk = _top_rows(Q, X, ipdf["i"].to_numpy(), qpdf["q"].to_numpy(), qpdf["ex"].to_numpy(),
                                 k, min_score)
        return pd.DataFrame({"q": q, "i": i, "score": sc, "rank": rk})

    def scored(asked: DataFrame) -> DataFrame:
        """The best k per query and chunk of ``asked`` (q, qv, qb, band)."""
        q_rep = asked.select("q", "qv", "qb", F.explode(F.get(chunks_of, F.col("band"))).alias("ic"))
        asking = q_rep.select(F.col("qb").alias("ib"), F.col("ic").alias("jc")).distinct()
        i_rep = placed.join(asking, placed["ic"] == asking["jc"]).select("i", "iv", "ib", "jc")
        q_rep = q_rep.join(ex, ["q", "ic"], "left") if ex is not None else q_rep.withColumn("ex", F.lit(None).cast(T.ArrayType(i_type)))
        return q_rep.groupBy("qb", "ic").cogroup(i_rep.groupBy("ib", "jc")).applyInPandas(block, out_schema)

    def best(parts_: DataFrame) -> DataFrame:
        w = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("i"))
        return parts_.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)

    early = [F.lit(b) for b in range(start) if bands[b].rows]
    top = best(scored(qv.withColumn("band", F.explode(F.array(*early)))))
    if any(b.rows for b in bands[start:]):
        top = top.checkpoint(eager=True)  # at most k rows a query, read twice below
        kth = top.where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
        rest = (qv.join(kth, "q", "left")
                .withColumn("band", F.explode(open_bands(C.l2_norm("qv"), F.col("kth"), bands, start, min_score))).drop("kth"))
        top = best(top.unionByName(scored(rest)))
    return top.select(F.col("q").alias(key), F.col("i").alias(item), "score", "rank")
