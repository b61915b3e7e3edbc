"""Registered queries over the driver's tables, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.engine import Engine
from vecspark.functions.distance import distance, quantize
from vecspark.operators import knn as K
from vecspark.operators.index import VectorIndex
from vecspark.plans.session import prepare, scratch_path
from vecspark.sources.options import ColumnOptions

DIM = 64
METRICS = ("L2", "IP", "COSINE")
RADIUS = 1.6


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id").withColumnRenamed("embedding", "vec")


def first(df: DataFrame, id_: int = 0) -> list[float]:
    """The query vector: that of one id, or zeros where it is missing."""
    row = df.where(F.col("id") == id_).select("vec").first()
    return list(row.vec) if row else [0.0] * DIM


def engine(spark: SparkSession) -> Engine:
    return Engine(spark, scratch_path(spark, "indexes"))


def rounded(df: DataFrame, column: str = "distance") -> DataFrame:
    return df.withColumn(column, F.round(F.col(column) + F.lit(0.0), 6))


def dist(metric: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    one = F.broadcast(df.where("id = 0").select(F.col("vec").alias("q")).limit(1))
    return rounded(df.join(one).select("id", distance(F.col("vec"), F.col("q"), metric).alias("distance")))


def dist_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine(spark)
    vectors(spark, sf_dir).createOrReplaceTempView("v_default")
    return spark.sql("SELECT a.id, round(vec_distance(a.vec, b.vec), 6) AS distance FROM v_default a, (SELECT vec FROM v_default WHERE id = 0) b")


def dist_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    one = F.broadcast(df.where("id = 0").select(F.slice("vec", 1, 32).alias("q")).limit(1))
    return rounded(df.join(one).select("id", distance(F.col("vec"), F.col("q"), "L2").alias("distance")))


def dist_zero_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", distance(F.col("vec"), F.array_repeat(F.lit(0.0).cast("float"), DIM), "COSINE").alias("distance"))


def dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine(spark)
    vectors(spark, sf_dir).createOrReplaceTempView("v_dot")
    return spark.sql("SELECT a.id, round(vec_dot(a.vec, b.vec), 6) AS dot FROM v_dot a, (SELECT vec FROM v_dot WHERE id = 0) b")


def construct_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector, written in four forms and an unclosed one, is parsed again; positions and values."""
    engine(spark)
    text = "array_join(transform(vec, x -> CAST(CAST(x AS DECIMAL(10,4)) AS STRING)), ', ')"
    forms = vectors(spark, sf_dir).selectExpr("id", f"concat('[', {text}, ' ]') AS a", f"concat('{{', {text}, '}}') AS b", f"concat('(', {text}, ')') AS c", f"{text} AS d", f"concat('[', {text}) AS e")
    long = forms.selectExpr("id", "stack(5, 0, a, 1, b, 2, c, 3, d, 4, e) AS (form, s)")
    return long.selectExpr("id", "form", "vec_construct(s) AS v").selectExpr("id", "form", "posexplode(v) AS (pos, value)").withColumn("value", F.round(F.col("value").cast("double"), 4))


def construct_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """construct with options: floats as they are, floats to bits, numbers of bytes to bits, bits as they are."""
    e = engine(spark)
    vectors(spark, sf_dir).createOrReplaceTempView("v_options")
    return e.sql(
        """SELECT id, vector_construct(vec, 'i=float,o=float') = vec AS same, vector_construct(vec, 'i=float,o=bv')[0] AS word,
        hex(substring(packed, 1, 2)) AS bits, vector_construct(packed, 'i=bv,o=bv') = packed AS same_bits
        FROM (SELECT *, vector_construct(concat('[', id % 256, ', ', id % 7, ']'), 'i=string,o=bv') AS packed FROM v_options)"""
    )


def construct_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that aren't finite, or no numbers, beside each vector's id."""
    engine(spark)
    parsed = vectors(spark, sf_dir).selectExpr("id", "vec_construct(concat('[', id, ', inf, -Infinity, nan, 1e2x, x]')) AS v")
    return parsed.selectExpr("id", "posexplode(v) AS (pos, value)").withColumn("value", F.col("value").cast("double").cast("string"))


def display_prec(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine(spark)
    return vectors(spark, sf_dir).selectExpr("id", "vec_display(vec, 4) AS text", "vec_display(vec) AS text7")


def dist_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distances of vectors of whole numbers from 0 to 255."""
    df = vectors(spark, sf_dir).select("id", F.transform("vec", lambda x: F.least(F.greatest(F.floor(x.cast("double") * 128 + 128), F.lit(0)), F.lit(255)).cast("int")).alias("b"))
    one = F.broadcast(df.where("id = 0").select(F.col("b").alias("q")).limit(1))
    return df.join(one).select("id", distance(F.col("b"), F.col("q"), "L2").cast("long").alias("distance"))


def is_valid_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine(spark)
    return vectors(spark, sf_dir).selectExpr("id", "vec_is_valid(vec, 64) AS ok64", "vec_is_valid(vec, 63) AS ok63", "vec_is_valid(CAST(NULL AS ARRAY<FLOAT>), 64) AS ok_null")


def bytes_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to bytes and back: whether the bytes are valid, and whether the values are the same."""
    engine(spark)
    out = vectors(spark, sf_dir).selectExpr("id", "vec", "vec_to_bytes(vec) AS b")
    return out.selectExpr("id", "vec_is_valid_bytes(b, 64) AS ok", "length(b) AS n_bytes", "vec_from_bytes(b) = vec AS same")


def sq_binary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.get(quantize(F.col("vec")), F.lit(0)).alias("word"))


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir).select("id", quantize(F.col("vec")).alias("w"))
    one = F.broadcast(df.where("id = 0").select(F.col("w").alias("q")).limit(1))
    return df.join(one).select("id", distance(F.col("w"), F.col("q"), "HAMMING").alias("distance"))


def knn_exact(metric: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(K.knn(df, first(df), 10, metric).select("id", "distance"))


def knn_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(K.knn_to_row(df, df.where("id = 7").select("vec"), 10).select("id", "distance"))


def knn_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir).select("id", quantize(F.col("vec")).alias("vec"))
    one = df.where("id = 0").select("vec")
    return K.knn_to_row(df, one, 10, "HAMMING").select("id", "distance")


def query_rows(df: DataFrame) -> DataFrame:
    """The queries of batch searches: every row whose id is divisible by 100."""
    return df.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("searchvec"))


def knn_batch(metric: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(K.knn_batch(df, query_rows(df), 5, metric))


def knn_batch_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the signs of a few dimensions, so that many are equal; ties go by id."""
    df = vectors(spark, sf_dir).select("id", F.transform(F.slice("vec", 1, 4), lambda x: F.signum(x).cast("float")).alias("vec"))
    return rounded(K.knn_batch(df, query_rows(df), 20))


def knn_batch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return K.neighbours_union(df, query_rows(df), 3).select("id", "label")


def lateral_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of each query by a lateral subquery, which the engine runs as a batch search."""
    e = engine(spark)
    df = vectors(spark, sf_dir)
    df.createOrReplaceTempView("v_lateral")
    query_rows(df).createOrReplaceTempView("v_lateral_queries")
    return rounded(e.sql("SELECT q.qid, n.id, n.distance FROM v_lateral_queries q, LATERAL (SELECT v.id, vec_distance(v.vec, q.searchvec) AS distance FROM v_lateral v ORDER BY distance, v.id LIMIT 3) n"))


def ann_filter(pre: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(K.filtered_knn(df, first(df), 50, F.col("label") == 3, pre=pre).select("id", "label", "distance"))


def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(K.range_search(df, first(df), RADIUS).select("id", "distance"))


def multivector_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(K.group_knn(df, first(df), 3, "label"))


def row_distance_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(K.row_distance(df.select("id"), K.knn(df, first(df), 10)), "row_distance")


def ann_set_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids as JSON text, by the SQL function over an index."""
    e, _, df = built(spark, sf_dir, f"type=KNN,dim={DIM}")
    df.createOrReplaceTempView("v_set")
    return e.sql("SELECT vector_ann_set('t.v.vec', 'id', (SELECT vec FROM v_set WHERE id = 0), 'nn=10') AS ids")


def ann_set_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON texts of each query's neighbours, exploded to rows and joined with the base table."""
    e, _, df = built(spark, sf_dir, f"type=KNN,dim={DIM}")
    df.createOrReplaceTempView("v_base")
    e.ann_sets("t.v.vec", query_rows(df), "nn=4").createOrReplaceTempView("v_sets")
    return spark.sql("SELECT j.qid, j.place, b.id, b.label FROM (SELECT qid, posexplode(from_json(ids, 'array<bigint>')) AS (place, near) FROM v_sets) j JOIN v_base b ON b.id = j.near")


def ann_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of rows of a derived table that an annotation restricts."""
    e, _, df = built(spark, sf_dir, f"type=KNN,dim={DIM}")
    df.createOrReplaceTempView("v_count")
    return e.sql("SELECT label, count(*) AS n FROM (SELECT id, label FROM v_count WHERE VECTOR_IS_ANN('t.v.vec', 'id', (SELECT vec FROM v_count WHERE id = 0), 'nn=40')) GROUP BY label")


def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIKE with a prefix, and a name cut at its first space."""
    prepare(spark).read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("v_part")
    return spark.sql("SELECT p_partkey, CASE WHEN locate(' ', p_name) > 0 THEN substr(p_name, 1, locate(' ', p_name) - 1) ELSE p_name END AS head, p_type LIKE 'S%' AS s_type FROM v_part ORDER BY p_type, p_partkey")


def built(spark: SparkSession, sf_dir: str, options: str, name: str = "t.v.vec") -> tuple[Engine, VectorIndex, DataFrame]:
    e = engine(spark)
    df = vectors(spark, sf_dir)
    index = e.add_index(name, options)
    index.build(df)
    return e, index, df


def is_ann_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _, df = built(spark, sf_dir, f"type=KNN,dim={DIM}")
    df.createOrReplaceTempView("v_is_ann")
    return e.sql("SELECT id, label, round(vec_row_distance(id), 6) AS distance FROM v_is_ann WHERE VECTOR_IS_ANN('t.v.vec', 'id', (SELECT vec FROM v_is_ann WHERE id = 0), 'nn=20') AND label < 5")


def search_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are a neighbour of any query."""
    e, _, df = built(spark, sf_dir, f"type=KNN,dim={DIM}")
    df.createOrReplaceTempView("v_search")
    query_rows(df).select("searchvec").createOrReplaceTempView("v_queries")
    return e.sql("SELECT id, label FROM VECTOR_SEARCH[v_search, id, t.v.vec, v_queries, nn=3]")


def index_batch(options: str, k: int, effort: int | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index, df = built(spark, sf_dir, options)
    return rounded(index.search_batch(query_rows(df), k, effort))


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _, _ = built(spark, sf_dir, f"type=KNN,dim={DIM},dist=Cosine")
    return e.index_status("t.v.vec").select("name", "type", "dim", "metric", "n_rows", "version")


def vector_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark)
    spark.sql("DROP TABLE IF EXISTS vecspark_words")
    e.sql("CREATE TABLE vecspark_words (wordid BIGINT, word STRING, wordvec VECTOR(dim=50,type=HNSW,m=8)) USING parquet")
    return e.vector_columns().where("tbl = 'vecspark_words'").select("tbl", "col", "options")


def refresh_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the events up to the first quarter of time is refreshed up to the third; its rows, old and new."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=int(x)) for x in events.select(F.percentile(at, F.lit(0.25)), F.percentile(at, F.lit(0.75))).first())
    rows = events.select("event_id", F.array(F.col("value"), F.lit(1.0)).cast("array<float>").alias("vec"), "ts")
    index = engine(spark).add_index("t.events.vec", "type=KNN,dim=2,track=ts")
    before = index.build(rows, "event_id", "vec", low, "ts")["rows"]
    index.refresh(rows, "event_id", "vec", "ts", high)
    return index.vectors().select(F.col("id").alias("event_id"), F.round(F.get("vec", F.lit(0)).cast("double"), 4).alias("value"), F.lit(before).cast("long").alias("n_before"))


def index_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids are replaced by their negatives, ids divisible by 5 removed; the sum of each vector."""
    _, index, df = built(spark, sf_dir, f"type=KNN,dim={DIM}")
    index.upsert(df.where("id % 2 = 0").select("id", F.transform("vec", lambda x: -x).alias("vec")))
    index.delete(df.where("id % 5 = 0").select("id"))
    return index.vectors().select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as changes of the vector of their user: the type tells the operation, the event's id the order."""
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.pmod("event_id", F.lit(7)) == 0, "D").when(F.pmod("event_id", F.lit(3)) == 0, "U").otherwise("I")
    return events.select(op.alias("op"), F.col("user_id").alias("id"), F.array(F.col("value"), F.lit(1.0)).cast("array<float>").alias("vec"), F.col("event_id").alias("seq"))


def cdc_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes, streamed in files of the change feed and applied to an index."""
    feed = scratch_path(spark, "feed")
    change_feed(spark, sf_dir).write.parquet(feed)
    e = engine(spark)
    index = e.add_index("t.users.vec", ColumnOptions.of("type=KNN,dim=2,online=Y,idcol=id"))
    index.load()
    stream = spark.readStream.schema("op string, id long, vec array<float>, seq long").parquet(feed)
    e.start_stream("t.users.vec", stream, scratch_path(spark, "cdc"), available_now=True).awaitTermination()
    return index.vectors().select("id", F.round(F.get("vec", F.lit(0)).cast("double"), 4).alias("value"))


def centroid_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = vectors(spark, sf_dir).select("label", F.posexplode("vec").alias("pos", "x"))
    return long.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dist_l2": partial(dist, "L2"),
    "dist_ip": partial(dist, "IP"),
    "dist_cosine": partial(dist, "COSINE"),
    "dist_default": dist_default,
    "dist_truncated": dist_truncated,
    "dist_zero_vector": dist_zero_vector,
    "dot_product": dot_product,
    "dist_bytes": dist_bytes,
    "construct_parse": construct_parse,
    "construct_options": construct_options,
    "construct_special": construct_special,
    "display_prec": display_prec,
    "is_valid_dim": is_valid_dim,
    "bytes_round_trip": bytes_round_trip,
    "sq_binary_words": sq_binary_words,
    "hamming_pairs": hamming_pairs,
    "knn_exact_l2": partial(knn_exact, "L2"),
    "knn_exact_ip": partial(knn_exact, "IP"),
    "knn_exact_cosine": partial(knn_exact, "COSINE"),
    "knn_scalar_subquery": knn_scalar_subquery,
    "knn_binary": knn_binary,
    "knn_batch_l2": partial(knn_batch, "L2"),
    "knn_batch_ip": partial(knn_batch, "IP"),
    "knn_batch_cosine": partial(knn_batch, "COSINE"),
    "knn_batch_ties": knn_batch_ties,
    "knn_batch_union": knn_batch_union,
    "lateral_topk": lateral_topk,
    "ann_pre_filter": partial(ann_filter, True),
    "ann_post_filter": partial(ann_filter, False),
    "range_search": range_search,
    "multivector_min": multivector_min,
    "row_distance_sentinel": row_distance_sentinel,
    "ann_set_json": ann_set_json,
    "ann_set_table": ann_set_table,
    "ann_count": ann_count,
    "name_parts": name_parts,
    "is_ann_rewrite": is_ann_rewrite,
    "search_rewrite": search_rewrite,
    "ivf_full_probe": partial(index_batch, f"type=IVF,dim={DIM},nlist=16", 5, 16),
    "ivf_partial_probe": partial(index_batch, f"type=IVF,dim={DIM},nlist=16", 5, 8),
    "hnsw_search": partial(index_batch, f"type=HNSW,dim={DIM},M=16,ef=100", 10, 100),
    "hnsw_bv_search": partial(index_batch, f"type=HNSW_BV,dim={DIM},M=16,ef=100", 10, 100),
    "index_status": index_status,
    "vector_columns": vector_columns,
    "refresh_window": refresh_window,
    "index_upsert_delete": index_upsert_delete,
    "cdc_last_write_wins": cdc_last_write_wins,
    "centroid_per_label": centroid_per_label,
}

_V = "(SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
_Q = f"(SELECT vec AS q FROM {_V} WHERE id = 0)"
_D = {
    "L2": "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    "IP": "1 - list_inner_product({a}, {b})",
    "COSINE": "CASE WHEN list_inner_product({a}, {a}) * list_inner_product({b}, {b}) = 0 THEN 1 ELSE 1 - list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b})) END",
}


def _d(metric: str, a: str = "vec", b: str = "q") -> str:
    return _D[metric].format(a=a, b=b)


def _knn(metric: str, k: int, where: str = "", columns: str = "id") -> str:
    return f"SELECT {columns}, round(d + 0.0, 6) AS distance FROM (SELECT id, label, {_d(metric)} AS d FROM {_V}, {_Q} {where} ORDER BY d, id LIMIT {k})"


def _batch(metric: str, k: int) -> str:
    return f"SELECT qid, rank::INTEGER AS rank, id, round(d + 0.0, 6) AS distance FROM (SELECT q.id AS qid, v.id, {_d(metric, 'v.vec', 'q.vec')} AS d, row_number() OVER (PARTITION BY q.id ORDER BY {_d(metric, 'v.vec', 'q.vec')}, v.id) AS rank FROM {_V} v, {_V} q WHERE q.id % 100 = 0) WHERE rank <= {k}"


_SIGNS = "list_transform(range(1, 65), lambda i: CASE WHEN vec[i] > 0 THEN 1 ELSE 0 END)"
_HAMMING = f"SELECT id, list_sum(list_transform(list_zip(s, q), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::DOUBLE AS distance FROM (SELECT id, {_SIGNS} AS s FROM {_V}), (SELECT {_SIGNS} AS q FROM {_V} WHERE id = 0)"

_WORD = "(list_sum(list_transform(range(2, 65), lambda i: CASE WHEN vec[i] > 0 THEN (1::HUGEINT << (64 - i)::INTEGER) ELSE 0::HUGEINT END)) - CASE WHEN vec[1] > 0 THEN 9223372036854775808::HUGEINT ELSE 0::HUGEINT END)::BIGINT"
_SIGN = "(SELECT vec_id AS id, list_transform(embedding[1:4], lambda x: sign(x)::DOUBLE) AS vec FROM embeddings)"

ORACLE_SQL: dict[str, str] = {
    "dist_l2": f"SELECT id, round({_d('L2')} + 0.0, 6) AS distance FROM {_V}, {_Q}",
    "dist_ip": f"SELECT id, round({_d('IP')} + 0.0, 6) AS distance FROM {_V}, {_Q}",
    "dist_cosine": f"SELECT id, round({_d('COSINE')} + 0.0, 6) AS distance FROM {_V}, {_Q}",
    "dist_default": f"SELECT id, round({_d('L2')} + 0.0, 6) AS distance FROM {_V}, {_Q}",
    "dist_truncated": f"SELECT id, round({_d('L2', 'vec[1:32]', 'q[1:32]')} + 0.0, 6) AS distance FROM {_V}, {_Q}",
    "dist_zero_vector": f"SELECT id, 1.0::DOUBLE AS distance FROM {_V}",
    "dot_product": f"SELECT id, round(list_inner_product(vec, q), 6) AS dot FROM {_V}, {_Q}",
    "dist_bytes": "SELECT id, list_sum(list_transform(list_zip(b, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM (SELECT vec_id AS id, list_transform(embedding, lambda x: least(greatest(floor(x::DOUBLE * 128 + 128), 0), 255)::INTEGER) AS b FROM embeddings), (SELECT list_transform(embedding, lambda x: least(greatest(floor(x::DOUBLE * 128 + 128), 0), 255)::INTEGER) AS q FROM embeddings WHERE vec_id = 0)",
    "construct_parse": "SELECT vec_id AS id, form::INTEGER AS form, (p - 1)::INTEGER AS pos, round(embedding[p]::DECIMAL(10,4)::FLOAT::DOUBLE, 4) AS value FROM embeddings, range(4) f(form), range(1, 65) r(p)",
    "construct_options": f"SELECT id, true AS same, {_WORD} AS word, format('{{:02X}}{{:02X}}', (id % 256)::INTEGER, (id % 7)::INTEGER) AS bits, true AS same_bits FROM {_V}",
    "construct_special": "SELECT vec_id AS id, p::INTEGER AS pos, CASE WHEN p = 0 THEN vec_id || '.0' ELSE ['Infinity', '-Infinity', 'NaN', '100.0', '0.0'][p] END AS value FROM embeddings, range(6) r(p)",
    "display_prec": "SELECT vec_id AS id, '[' || array_to_string(list_transform(embedding, lambda x: format('{:.4g}', x)), ', ') || ']' AS text, '[' || array_to_string(list_transform(embedding, lambda x: format('{:.7g}', x)), ', ') || ']' AS text7 FROM embeddings",
    "is_valid_dim": "SELECT vec_id AS id, embedding IS NOT NULL AND len(embedding) = 64 AS ok64, embedding IS NOT NULL AND len(embedding) = 63 AS ok63, false AS ok_null FROM embeddings",
    "bytes_round_trip": "SELECT vec_id AS id, len(embedding) = 64 AS ok, (len(embedding) * 4 + 8)::INTEGER AS n_bytes, true AS same FROM embeddings",
    "sq_binary_words": f"SELECT id, {_WORD} AS word FROM {_V}",
    "hamming_pairs": _HAMMING,
    "knn_exact_l2": _knn("L2", 10),
    "knn_exact_ip": _knn("IP", 10),
    "knn_exact_cosine": _knn("COSINE", 10),
    "knn_scalar_subquery": _knn("L2", 10).replace("WHERE id = 0", "WHERE id = 7"),
    "knn_binary": f"{_HAMMING} ORDER BY distance, id LIMIT 10",
    "knn_batch_l2": _batch("L2", 5),
    "knn_batch_ip": _batch("IP", 5),
    "knn_batch_cosine": _batch("COSINE", 5),
    "knn_batch_ties": _batch("L2", 20).replace(_V, _SIGN),
    "lateral_topk": f"SELECT qid, id, distance FROM ({_batch('L2', 3)})",
    "ann_set_table": f"SELECT n.qid, (n.rank - 1)::INTEGER AS place, n.id, e.label FROM ({_batch('L2', 4)}) n JOIN embeddings e ON e.vec_id = n.id",
    "ann_count": f"SELECT label, count(*) AS n FROM ({_knn('L2', 40, '', 'id, label')}) GROUP BY label",
    "name_parts": "SELECT p_partkey, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE p_name END AS head, p_type LIKE 'S%' AS s_type FROM part",
    "knn_batch_union": f"SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT id FROM ({_batch('L2', 3)}))",
    "ann_pre_filter": _knn("L2", 50, "WHERE label = 3", "id, label"),
    "ann_post_filter": f"SELECT * FROM ({_knn('L2', 50, '', 'id, label')}) WHERE label = 3",
    "range_search": f"SELECT id, round({_d('L2')} + 0.0, 6) AS distance FROM {_V}, {_Q} WHERE {_d('L2')} <= {RADIUS}",
    "multivector_min": f"SELECT label, round(min({_d('L2')}) + 0.0, 6) AS distance FROM {_V}, {_Q} GROUP BY label ORDER BY min({_d('L2')}), label LIMIT 3",
    "row_distance_sentinel": f"SELECT e.vec_id AS id, coalesce(n.distance, 99999999999.99) AS row_distance FROM embeddings e LEFT JOIN ({_knn('L2', 10)}) n ON n.id = e.vec_id",
    "ann_set_json": f"SELECT '[' || string_agg(id::VARCHAR, ',' ORDER BY d, id) || ']' AS ids FROM (SELECT id, {_d('L2')} AS d FROM {_V}, {_Q} ORDER BY d, id LIMIT 10)",
    "is_ann_rewrite": f"SELECT * FROM ({_knn('L2', 20, '', 'id, label')}) WHERE label < 5",
    "search_rewrite": f"SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT id FROM ({_batch('L2', 3)}))",
    "ivf_full_probe": _batch("L2", 5),
    "index_status": f"SELECT 't.v.vec' AS name, 'KNN' AS type, {DIM} AS dim, 'COSINE' AS metric, count(*) AS n_rows, 1::BIGINT AS version FROM embeddings",
    "vector_columns": "SELECT 'vecspark_words' AS tbl, 'wordvec' AS col, 'type=HNSW,dim=50,m=8' AS options",
    "refresh_window": "SELECT event_id, round(value::FLOAT::DOUBLE, 4) AS value, (SELECT count(*) FROM events WHERE epoch_us(ts) <= a) AS n_before FROM events, (SELECT floor(quantile_cont(epoch_us(ts)::DOUBLE, 0.25))::BIGINT AS a, floor(quantile_cont(epoch_us(ts)::DOUBLE, 0.75))::BIGINT AS b FROM events) WHERE epoch_us(ts) <= b",
    "index_upsert_delete": "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]) * CASE WHEN vec_id % 2 = 0 THEN -1 ELSE 1 END, 6) AS total FROM embeddings WHERE vec_id % 5 <> 0",
    "cdc_last_write_wins": "SELECT id, round(value::FLOAT::DOUBLE, 4) AS value FROM (SELECT user_id AS id, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events WHERE user_id IS NOT NULL GROUP BY 1) WHERE seq % 7 <> 0",
    "centroid_per_label": f"SELECT label, (p - 1)::INTEGER AS pos, round(avg(vec[p]), 6) AS mean FROM {_V}, range(1, 65) r(p) GROUP BY ALL",
}
