"""Adapters from the given parquet tables to the engine's data model.

* events (+ part)            -> D2 event table / D1 action log / interactions
* part                       -> D3 item dimension (category = position of p_type)
* lineitem + orders (+ part) -> a larger interaction catalog (customer x part)
* customer (+ part)          -> D10 request table (available items from part; one segment are guests)
* embeddings                 -> D9 item vectors (vec_id = item id) and user vectors
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marmot import schemas as S
from marmot.functions import columns as C
from marmot.operators import prepare as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 item dimension: item_id, price, title, category_idx."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_retailprice").cast("double").alias("price"),
        F.col("p_name").alias("title"),
        C.lookup("p_type", S.PART_TYPE_CATEGORY).cast("int").alias("category_idx"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 event table: event_id, user_id, item_id (= props.k), action, ts."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        F.col("event_type").alias("action"), "ts")


def interactions(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """Enriched events with weight and label (event-table vocabulary)."""
    df = P.enrich(events(spark, sf_dir), items(spark, sf_dir), how=how)
    df = P.with_action_weight(df, S.EVENTS_ACTION_WEIGHTS)
    return P.with_action_label(df, S.EVENTS_ACTION_WEIGHTS)


def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fit_zscore(items(spark, sf_dir), "price")


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 rows (plus ts and event_id) before splitting: raw ids kept (H1), price z-scored
    with statistics fitted on the item dimension."""
    df = interactions(spark, sf_dir)
    df = P.zscore(df, price_stats(spark, sf_dir), "price", "price_norm")
    return df.select(F.col("user_id").alias("user_idx"), F.col("item_id").alias("item_idx"),
                     "label", "weight", "price_norm", "category_idx", "ts", "event_id")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 action log rendered from events: epoch-ms timestamp, string user id,
    upper-case action (view/click/purchase hit the log vocabulary, signup/error
    take the default weight)."""
    df = P.enrich(events(spark, sf_dir), items(spark, sf_dir), how="inner")
    return df.select(
        C.ts_millis("ts").alias("timestamp"),
        F.col("item_id").cast("bigint").alias("item_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.upper("action").alias("action"),
        F.col("category_idx").cast("int").alias("category_id"),
        F.col("price").cast("double").alias("price"),
        "event_id")


def order_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigger catalog: one row per line item; user = customer, item = part,
    weight = quantity, ts = order date."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    it = items(spark, sf_dir)
    df = li.join(o, li.l_orderkey == o.o_orderkey).join(it, li.l_partkey == it.item_id)
    return df.select(F.col("o_custkey").alias("user_idx"), F.col("l_partkey").alias("item_idx"),
                     F.lit(1).cast("int").alias("label"), F.col("l_quantity").cast("double").alias("weight"),
                     "price", "category_idx", F.col("o_orderdate").alias("ts"))


def catalog_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows over the whole item table: one per line item, weight = quantity (5 counts as a
    purchase), price z-scored with the statistics of the item dimension."""
    df = P.zscore(order_interactions(spark, sf_dir), price_stats(spark, sf_dir), "price", "price_norm")
    return df.select(*S.TRAINING_COLUMNS)


#: items of one shelf, and so of one request's list: long enough that the cuts at 250 and 100 act
SHELF_ITEMS = 400


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10 request table, one request per customer.

    The item table is laid out in shelves of about SHELF_ITEMS items; a request's available items
    are its customer's shelf.  Customers of the MACHINERY segment are guests, whom no training row
    knows.  top_n 10; category = nation key + 1 for nations 0..5 else none; the page starts at 11
    for BUILDING, at 96 for FURNITURE (it meets the end of the served results), else at 1.
    """
    it = items(spark, sf_dir)
    n_shelves = F.lit(max(1, -(-it.count() // SHELF_ITEMS)))
    shelves = (it.groupBy(F.pmod(F.col("item_id"), n_shelves).alias("_shelf"))
               .agg(F.sort_array(F.collect_list("item_id")).alias("available_items")))  # about SHELF_ITEMS ids each
    c = table(spark, sf_dir, "customer")
    # the planner takes a gathered list for a narrow column and would broadcast the whole item table
    c = c.join(shelves.hint("merge"), F.pmod(F.col("c_custkey"), n_shelves) == F.col("_shelf"))
    return c.select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", -1 - F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("user_id"),
        F.lit(10).cast("int").alias("top_n"),
        F.when(F.col("c_nationkey") < 6, F.col("c_nationkey") + 1).cast("int").alias("category_id"),
        "available_items",
        F.when(F.col("c_mktsegment") == "BUILDING", 11).when(F.col("c_mktsegment") == "FURNITURE", 96).otherwise(1).cast("int").alias("rank"))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9: item vector of item i is the embedding with vec_id = i."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_idx"), "embedding")


def catalog_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every item of the item table: the embedding with vec_id = item mod (number of vectors)."""
    return user_vectors(spark, sf_dir, items(spark, sf_dir), "item_id").select(F.col("item_id").alias("item_idx"), F.col("user_vec").alias("embedding"))


def user_vectors(spark: SparkSession, sf_dir: str, users: DataFrame, user: str = "user_idx") -> DataFrame:
    """User vector of user u is the embedding with vec_id = u mod (number of vectors)."""
    emb = table(spark, sf_dir, "embeddings")
    n = emb.select(F.count(F.lit(1))).scalar()
    u = users.select(user).distinct().withColumn("_vid", F.pmod(F.col(user), n))
    return u.join(emb, u["_vid"] == emb["vec_id"]).select(user, F.col("embedding").alias("user_vec"))


def given_ranker(cands: DataFrame) -> DataFrame:
    """A fixed, SQL-reproducible stand-in for a fitted ranker's score (oracle checks only):
    sigmoid(price_norm - mf_score / 4)."""
    return cands.withColumn("ranker_score", C.sigmoid(F.col("price_norm") - F.col("mf_score") / 4.0))
