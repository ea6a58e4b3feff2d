"""The registered queries over the algebra and the ranking library, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.functions import bits, dates, lookups, segments, text, urls, vectors
from rankflow.ltr import boost, data, findstep, metrics, quantize, transforms
from rankflow.operators import filtering, joins, ordering, projection, reduction
from rankflow.plans.expression import evaluate
from rankflow.relation import Relation
from rankflow.sources import readers
from rankflow.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str, key: str | None = None) -> Relation:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return Relation(df, (key or df.columns[0],), "table", name)


def _counts(r: Relation) -> DataFrame:
    return r.df.select("key", F.col("count").cast("long").alias("count"))


# Ranking rows: a query is an order, its rows the order's lines; the label is made from the quantity, the score from the price.
_RANKED_SQL = "r AS (SELECT l_orderkey AS q, l_partkey * 10 + l_linenumber AS tie, CAST(floor((l_quantity - 1) / 10) AS INTEGER) AS label, CAST(floor(l_extendedprice / 20000) AS BIGINT) AS score FROM lineitem)"
_GAIN_SQL = "CASE label WHEN 0 THEN 0.0 WHEN 1 THEN 3.0 WHEN 2 THEN 7.0 WHEN 3 THEN 15.0 ELSE 31.0 END::DOUBLE"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").df.select(
        F.col("l_orderkey").alias("q"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("tie"), F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("label"), F.floor(F.col("l_extendedprice") / 20000).cast("long").alias("score")
    )


# --- The algebra


@query("SELECT l_returnflag AS key, SUM(CAST(l_quantity AS BIGINT))::BIGINT AS count FROM lineitem GROUP BY 1")
def count_reduce(spark, d):
    lines = _t(spark, d, "lineitem")
    lines = lines.with_df(lines.df.select("l_returnflag", F.col("l_quantity").cast("long").alias("l_quantity")), keys=("l_returnflag",))
    return _counts(ordering.sort(reduction.reduce(projection.to_count(lines, "l_returnflag", "l_quantity"))))


@query("SELECT w AS key, count(*)::BIGINT AS count FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1")
def word_count(spark, d):
    words = _t(spark, d, "documents").df.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("key"))
    return _counts(reduction.reduce(projection.to_count(Relation(words, ("key",), "line"), "$1")))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def where_filter(spark, d):
    return filtering.where(_t(spark, d, "orders"), "record.O_TotalPrice > 200000 && record.o_orderstatus == 'F'").df.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT p_name, p_partkey FROM part WHERE p_name LIKE (SELECT substr(min(p_name), 1, 3) FROM part) || '%'")
def key_prefix(spark, d):
    part = _t(spark, d, "part", "p_name")
    prefix = part.df.agg(F.min("p_name")).first()[0][:3]
    return filtering.key_query(part, f"{prefix}*").df.select("p_name", "p_partkey")


@query("SELECT * FROM nation WHERE n_name = 'NATION_7' OR n_nationkey = 7")
def key_match(spark, d):
    nation = _t(spark, d, "nation")
    return filtering.key_query(nation, "{55}").df


@query("SELECT DISTINCT concat_ws(chr(9), c_mktsegment, c_nationkey::VARCHAR) AS key FROM customer")
def to_line(spark, d):
    return projection.to_line(_t(spark, d, "customer"), "c_mktsegment+c_nationkey").df.distinct()


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join_keyed(spark, d):
    return joins.inner_join(_t(spark, d, "orders", "o_custkey"), _t(spark, d, "customer")).df.select("o_orderkey", "o_custkey", "o_totalprice", "c_name", "c_nationkey")


@query("SELECT c_custkey, c_name, coalesce(o_orderpriority, '') AS o_orderpriority, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey")
def left_outer_blank(spark, d):
    orders = filtering.where(_t(spark, d, "orders", "o_custkey"), "o_totalprice > 400000")
    return joins.left_outer_join(_t(spark, d, "customer"), orders).df.select("c_custkey", "c_name", "o_orderpriority", "o_totalprice")


@query('SELECT a.n_nationkey, a.n_name, b.n_name AS "nation:n_name", b.n_nationkey AS "nation:n_nationkey" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey')
def join_renamed(spark, d):
    a, b = (Relation(_t(spark, d, "nation").df, ("n_regionkey",), "table", "nation") for _ in range(2))
    return joins.inner_join(a, b).df.select("n_nationkey", "n_name", "`nation:n_name`", "`nation:n_nationkey`")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, d):
    return joins.filter_by_right(_t(spark, d, "customer"), filtering.where(_t(spark, d, "orders", "o_custkey"), "o_totalprice > 400000")).df.select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, d):
    return joins.filter_not_right(_t(spark, d, "customer"), filtering.where(_t(spark, d, "orders", "o_custkey"), "o_totalprice > 400000")).df.select("c_custkey", "c_name")


def _names(spark, d):
    return projection.to_line(_t(spark, d, "customer"), "c_name"), projection.to_line(_t(spark, d, "supplier"), "s_name")


@query("SELECT c_name AS key FROM customer UNION ALL SELECT s_name FROM supplier")
def merge_sorted(spark, d):
    return joins.merge("+", *_names(spark, d)).df


@query("SELECT c_name AS key FROM customer UNION ALL SELECT s_name FROM supplier")
def concat_streams(spark, d):
    return joins.concat(*_names(spark, d)).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) DESC LIMIT 25")
def head_sorted(spark, d):
    return ordering.head(ordering.sort(_t(spark, d, "orders"), "-"), 25).df.select("o_orderkey", "o_totalprice")


@query("SELECT r_regionkey, r_name FROM region ORDER BY md5(concat_ws(chr(9), '31415927', r_regionkey::VARCHAR, r_name)) LIMIT 3")
def random_sample(spark, d):
    return ordering.random(_t(spark, d, "region"), 3).df


@query("SELECT 'orders' AS name, 'table' AS kind, 'o_orderkey,o_custkey,o_orderstatus,o_orderdate,o_orderpriority' AS columns, 'o_orderkey' AS key, count(*)::BIGINT AS num_records, sum(strlen(concat_ws(chr(9), o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderdate::VARCHAR, o_orderpriority)))::BIGINT AS num_bytes, '' AS sorted FROM orders")
def about_stats(spark, d):
    return reduction.about((r := _t(spark, d, "orders")).with_df(r.df.drop("o_totalprice")))


@query("SELECT conv_id::VARCHAR AS key, string_agg(role || ':' || text, '' ORDER BY turn) AS value FROM conversations GROUP BY conv_id")
def string_append(spark, d):
    df = _t(spark, d, "conversations").df.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("pos"), F.concat_ws(":", "role", "text").alias("value"))
    return reduction.reduce(Relation(df, ("key",), "string")).df.select("key", "value")


@query("SELECT user_id::VARCHAR AS key, event_type AS edge, count(*)::BIGINT AS weight FROM events GROUP BY ALL")
def map_merge(spark, d):
    df = _t(spark, d, "events").df.select(F.col("user_id").cast("string").alias("key"), F.create_map("event_type", F.lit(1)).alias("edges"))
    return reduction.reduce(Relation(df, ("key",), "map")).df.select("key", F.explode("edges").alias("edge", "weight"))


@query("SELECT c_mktsegment, c_nationkey, min(c_name) AS c_name, sum(CAST(c_acctbal * 100 AS BIGINT))::BIGINT AS cents FROM customer GROUP BY ALL")
def user_reducer(spark, d):
    df = _t(spark, d, "customer").df.select("c_mktsegment", "c_nationkey", "c_name", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    return reduction.reduce(Relation(df, ("c_mktsegment", "c_nationkey")), {"c_name": F.min, "cents": F.sum}).df


@query("SELECT key, SUM(n)::BIGINT AS count FROM (SELECT n_name AS key, 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0) GROUP BY 1 ORDER BY key DESC LIMIT 5")
def expression_query(spark, d):
    tables = {"customer": _t(spark, d, "customer", "c_nationkey"), "nation": _t(spark, d, "nation")}
    return _counts(evaluate(spark, "customer ^ Where(record.c_acctbal > 0) ^ nation ^ InnerJoin ^ ToCount(n_name) ^ Reduce ^ Sort(-) ^ Head(5)", tables))


def _doubled(batches):
    n = 0
    for pdf in batches:
        pdf = pdf[pdf.s_acctbal > 0]
        n += len(pdf)
        yield pdf.assign(s_acctbal=pdf.s_acctbal * 2)


filtering.register_filter("doubled", _doubled)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_acctbal > 0")
def user_filter(spark, d):
    return filtering.user_filter(_t(spark, d, "supplier"), "doubled").df


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_discount = 0.1)")
def bloom_semi_join(spark, d):
    """The filter thins the left side out; the exact join decides."""
    right = _t(spark, d, "lineitem").df.where("l_quantity = 50 and l_discount = 0.1").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    left = reduction.bloom_filtered(_t(spark, d, "supplier").df, "s_suppkey", reduction.bloom_filter(right, "s_suppkey"))
    return left.join(right, "s_suppkey", "left_semi").select("s_suppkey")


# --- Windows and ranks


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3")
def topn_per_group(spark, d):
    return ordering.top_n(_t(spark, d, "orders").df.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", 3, "o_orderkey")


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1)::INTEGER AS rank FROM events")
def rank_in_group(spark, d):
    return ordering.rank0(_t(spark, d, "events").df, "user_id", "value", "event_id").select("user_id", "event_id", "rank")


@query("SELECT l_orderkey, l_linenumber, l_partkey, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative FROM lineitem")
def cumulative_sum(spark, d):
    df = _t(spark, d, "lineitem").df.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"))
    return vectors.cumulative(df, "quantity", ["l_orderkey"], ["l_linenumber", "l_partkey", "quantity"]).drop("quantity")


@query("""WITH a AS (SELECT user_id, event_type, row_number() OVER w - 1 AS pos, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM a)
SELECT user_id, min(pos)::BIGINT AS start, count(*)::BIGINT AS length, min(event_type) AS value FROM b GROUP BY user_id, run""")
def run_length(spark, d):
    return vectors.run_lengths(_t(spark, d, "events").df.select("user_id", "event_id", "event_type"), "event_type", ["event_id"], ["user_id"])


@query("""WITH a AS (SELECT user_id, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, (sum(new) OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS group_no FROM a""")
def contiguous_groups(spark, d):
    return ordering.contiguous_groups(_t(spark, d, "events").df, "event_type", ["event_id"], ["user_id"]).select("user_id", "event_id", "group_no")


@query("SELECT o_custkey, count(*)::BIGINT AS size, (sum(count(*)) OVER (ORDER BY o_custkey) - count(*))::BIGINT AS start FROM orders GROUP BY 1")
def group_sizes(spark, d):
    return data.group_sizes(_t(spark, d, "orders").df, "o_custkey")


@query("SELECT l_orderkey, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'valid' ELSE 'test' END AS split FROM (SELECT DISTINCT l_orderkey, CAST('0x' || substr(md5('5:' || l_orderkey), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM lineitem)")
def partition_groups(spark, d):
    return ordering.partitioned(_t(spark, d, "lineitem").df.select("l_orderkey").distinct(), "l_orderkey", "6:2:2", 5)


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE CAST('0x' || substr(md5('0:' || l_orderkey), 1, 8) AS BIGINT) / 4294967296.0 BETWEEN 0.2 AND 0.4")
def range_sampled_groups(spark, d):
    return ordering.in_range(_t(spark, d, "lineitem").df.select("l_orderkey").distinct(), "l_orderkey", 0.2, 0.4)


# --- Ranking metrics


def _dcg_sql(order: str) -> str:
    return f"WITH {_RANKED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {order}) - 1 AS rk FROM r) SELECT q, round(sum(CASE WHEN rk < 3 THEN {_GAIN_SQL} / ln(2.0 + rk) ELSE 0 END), 6) AS dcg FROM k GROUP BY q"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_dcg_sql("score DESC, label DESC"))
def dcg_optimistic(spark, d):
    return _rounded(metrics.dcg(_ranked(spark, d), "q", "label", "score", 3, "optimistic"), "dcg")


@query(_dcg_sql("score DESC, label"))
def dcg_pessimistic(spark, d):
    return _rounded(metrics.dcg(_ranked(spark, d), "q", "label", "score", 3), "dcg")


@query(f"""WITH {_RANKED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, label) - 1 AS rk FROM r),
b AS (SELECT q, score, avg({_GAIN_SQL}) * sum(CASE WHEN rk < 3 THEN 1 / ln(2.0 + rk) ELSE 0 END) AS part FROM k GROUP BY q, score) SELECT q, round(sum(part), 6) AS dcg FROM b GROUP BY q""")
def dcg_mean(spark, d):
    return _rounded(metrics.dcg(_ranked(spark, d), "q", "label", "score", 3, "mean"), "dcg")


@query(_dcg_sql("label DESC"))
def max_dcg(spark, d):
    return _rounded(metrics.extreme_dcg(_ranked(spark, d), "q", "label", 3), "dcg")


@query(_dcg_sql("label"))
def min_dcg(spark, d):
    return _rounded(metrics.extreme_dcg(_ranked(spark, d), "q", "label", 3, best=False), "dcg")


def _ndcg_sql(keep: str) -> str:
    return f"""WITH {_RANKED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, label) - 1 AS rk, row_number() OVER (PARTITION BY q ORDER BY label DESC) - 1 AS bk FROM r),
s AS (SELECT q, sum(CASE WHEN rk < 3 THEN {_GAIN_SQL} / ln(2.0 + rk) ELSE 0 END) AS a, sum(CASE WHEN bk < 3 THEN {_GAIN_SQL} / ln(2.0 + bk) ELSE 0 END) AS b, min(label) AS lo, max(label) AS hi FROM k GROUP BY q)
SELECT q, round(a / b, 6) AS ndcg FROM s WHERE {keep}"""


@query(_ndcg_sql("lo <> hi"))
def ndcg_at_k(spark, d):
    return _rounded(metrics.ndcg(_ranked(spark, d), "q", "label", "score", 3), "ndcg")


@query(_ndcg_sql("b > 0"))
def ndcg_by_gain(spark, d):
    return _rounded(metrics.ndcg(_ranked(spark, d), "q", "label", "score", 3, rule="gain"), "ndcg")


@query(f"WITH {_RANKED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, tie) AS rk FROM r) SELECT q, round(coalesce(1.0 / min(CASE WHEN label > 0 THEN rk END), 0), 6)::DOUBLE AS rr FROM k GROUP BY q")
def reciprocal_rank(spark, d):
    return _rounded(metrics.reciprocal_rank(_ranked(spark, d), "q", "label", "score", "tie"), "rr")


@query(f"WITH {_RANKED_SQL} SELECT a.q, count(*)::BIGINT AS pairs, sum((b.score >= a.score)::INT)::BIGINT AS errors, round(avg((b.score >= a.score)::INT), 6) AS error FROM r a JOIN r b ON a.q = b.q AND a.label > b.label GROUP BY 1")
def pair_error(spark, d):
    return _rounded(metrics.pair_error(_ranked(spark, d), "q", "label", "score"), "error")


@query(f"WITH {_RANKED_SQL} SELECT a.q, round(avg(ln(1 + exp(-2.0 * (a.score - b.score)))), 6) AS entropy FROM r a JOIN r b ON a.q = b.q AND a.label > b.label GROUP BY 1")
def pair_cross_entropy(spark, d):
    return _rounded(metrics.cross_entropy(_ranked(spark, d), "q", "label", "score"), "entropy")


@query("SELECT round(avg(CASE WHEN quality = p OR (quality <= 0 AND p = 0) THEN 0.0 ELSE 1.0 END), 6)::DOUBLE AS error FROM (SELECT quality, (n_chars > 1000)::INT AS p FROM labels JOIN documents USING (doc_id))")
def class_error(spark, d):
    both = _t(spark, d, "labels").df.join(_t(spark, d, "documents").df, "doc_id").select("quality", (F.col("n_chars") > 1000).cast("int").alias("p"))
    return _rounded(metrics.class_error(both, "quality", "p"), "error")


@query("""WITH p AS (SELECT quality, n_chars / 3000.0 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT sum((p >= 0.5 AND quality > 0)::INT)::BIGINT AS tp, sum((p >= 0.5 AND quality <= 0)::INT)::BIGINT AS fp, sum((p < 0.5 AND quality > 0)::INT)::BIGINT AS fn, sum((p < 0.5 AND quality <= 0)::INT)::BIGINT AS tn FROM p)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((fp + fn) / (tp + fp + fn + tn), 6) AS error FROM c""")
def precision_recall(spark, d):
    both = _t(spark, d, "labels").df.join(_t(spark, d, "documents").df, "doc_id").select("quality", (F.col("n_chars") / 3000.0).alias("p"))
    return _rounded(metrics.confusion(both, "quality", "p"), "precision", "recall", "error")


@query("SELECT round(sqrt(avg((l_tax * 100 - l_discount * 100) ** 2)), 6) AS rmse, round(avg(abs(l_tax * 100 - l_discount * 100)), 6) AS mae FROM lineitem")
def regression_errors(spark, d):
    return _rounded(metrics.regression_error(_t(spark, d, "lineitem").df.select((F.col("l_tax") * 100).alias("y"), (F.col("l_discount") * 100).alias("f")), "y", "f"), "rmse", "mae")


# --- Binning, histograms, splits


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_size) - 1)::BIGINT AS code FROM part")
def quantize_codes(spark, d):
    return quantize.dense_codes(_t(spark, d, "part").df.select("p_partkey", "p_size"), "p_size").select("p_partkey", "code")


@query("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 3 WHEN p_size >= 25 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END AS code FROM part")
def encode_codes(spark, d):
    return _t(spark, d, "part").df.select("p_partkey", quantize.encode(F.col("p_size"), [0.0, 10.0, 25.0, 40.0]).alias("code"))


@query("SELECT 'p_size' AS feature, count(DISTINCT p_size)::INTEGER AS bins, min(p_size)::DOUBLE AS first FROM part")
def codebook(spark, d):
    long = _t(spark, d, "part").df.select(F.lit("p_size").alias("feature"), F.col("p_size").cast("double").alias("value"))
    return quantize.codebook(long).select("feature", F.size("starts").alias("bins"), F.element_at("starts", 1).alias("first"))


@query("""WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), p AS (SELECT greatest(least(ceil((l_quantity - lo) * 7 / (hi - lo)) - 1, 6), 0)::INTEGER AS bin, lo, hi FROM lineitem, b)
SELECT bin, round(lo + bin * (hi - lo) / 7, 6) AS low, round(lo + (bin + 1) * (hi - lo) / 7, 6) AS high, count(*)::BIGINT AS n FROM p GROUP BY bin, lo, hi""")
def hist_equal_width(spark, d):
    return _rounded(vectors.histogram(_t(spark, d, "lineitem").df, "l_quantity", 7), "low", "high")


_LONG_SQL = """f AS (SELECT (l_quantity > 25)::INT AS node, l_linenumber AS a, CAST(round(l_discount * 100) AS INTEGER) AS b, CAST(round(l_tax * 100) AS BIGINT) AS response FROM lineitem),
g AS (SELECT node, 0 AS feature, a AS bin, response FROM f UNION ALL SELECT node, 1, b, response FROM f), h AS (SELECT node, feature, bin, count(*)::BIGINT AS n, sum(response)::BIGINT AS total FROM g GROUP BY ALL)"""


def _long(spark, d):
    base = _t(spark, d, "lineitem").df.select((F.col("l_quantity") > 25).cast("int").alias("node"), F.array(F.col("l_linenumber"), F.round(F.col("l_discount") * 100).cast("int")).alias("codes"), F.round(F.col("l_tax") * 100).cast("long").alias("response"))
    return base.select("node", F.posexplode("codes").alias("feature", "bin"), "response")


@query(f"WITH {_LONG_SQL} SELECT * FROM h")
def split_histogram(spark, d):
    return quantize.split_histogram(_long(spark, d))


@query(f"""WITH {_LONG_SQL}, s AS (SELECT node, feature, bin, sum(n) OVER w AS nl, sum(total) OVER w AS sl, sum(n) OVER p AS na, sum(total) OVER p AS sa FROM h WINDOW w AS (PARTITION BY node, feature ORDER BY bin), p AS (PARTITION BY node, feature)),
x AS (SELECT node, feature, bin, sl::DOUBLE * sl / nl + (sa - sl)::DOUBLE * (sa - sl) / (na - nl) - sa::DOUBLE * sa / na AS gain FROM s WHERE nl >= 15 AND na - nl >= 15)
SELECT node, feature, bin, round(gain, 4) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) AS k FROM x) WHERE k = 1""")
def best_split(spark, d):
    h = quantize.split_histogram(_long(spark, d)).withColumn("total", F.col("total").cast("double"))
    return quantize.best_splits(h, 15).withColumn("gain", F.round("gain", 4))


@query("SELECT p_partkey, i AS slot, (i = p_size % 5)::INTEGER AS value FROM part, range(5) t(i)")
def bin_one_hot(spark, d):
    return _t(spark, d, "part").df.select("p_partkey", F.posexplode(data.one_hot(F.col("p_size") % 5, 5)).alias("slot", "value")).select("p_partkey", F.col("slot").cast("long").alias("slot"), "value")


@query("SELECT p_partkey, (p_size % 3 = 0)::INT::DOUBLE AS \"kind:0\", (p_size % 3 = 1)::INT::DOUBLE AS \"kind:1\", (p_size IN (1, 11))::INT::DOUBLE AS \"tags:0\", (p_size IN (2, 12))::INT::DOUBLE AS \"tags:1\", p_retailprice AS price FROM part")
def feature_expansion(spark, d):
    df = _t(spark, d, "part").df.select(F.col("p_partkey").alias("m:DocId"), (F.col("p_size") % 3).cast("string").alias("bin:2:kind"), F.concat(F.when(F.col("p_size").isin(1, 11), "0 ").otherwise(""), F.when(F.col("p_size").isin(2, 12), "1").otherwise("7")).alias("sparse:2:tags"), F.col("p_retailprice").alias("price"))
    return df.select(F.col("`m:DocId`").alias("p_partkey"), *data.feature_columns(df))


@query("SELECT label, count(*)::BIGINT AS n FROM (SELECT CASE p_size % 5 WHEN 0 THEN 4.0 WHEN 1 THEN 2.0 WHEN 2 THEN -1.0 WHEN 3 THEN 7.5 ELSE 0.0 END::DOUBLE AS label FROM part) GROUP BY 1")
def label_map(spark, d):
    names = F.element_at(F.array(*map(F.lit, ["Perfect", "good", "", "7.5", "what"])), F.col("p_size") % 5 + 1)
    return _t(spark, d, "part").df.select(data.label_of(names).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RANKED_SQL} SELECT q, tie FROM r WHERE q IN (SELECT q FROM r GROUP BY q HAVING min(label) <> max(label))")
def degenerate_queries_removed(spark, d):
    return data.without_degenerate(_ranked(spark, d), "q", "label").select("q", "tie")


# --- Scalars


@query("SELECT page_id, 'h' AS letter, length(url) AS size, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages")
def url_round_trip(spark, d):
    """The host of the URL that a reversed URL gives back; a lost or changed one would show."""
    df = _t(spark, d, "pages").df.withColumn("turned", urls.reverse(F.col("url"))).withColumn("back", urls.reverse_back(F.col("turned")))
    size = F.when(F.col("back") == F.col("url"), F.length("back")).otherwise(-1)
    return df.select("page_id", F.lit("h").alias("letter"), size.cast("long").alias("size"), urls.host(F.col("back")).alias("host"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h, string_split(regexp_extract(url, '^https?://([^/:?#]+)', 1), '.') AS l, regexp_extract(url, '^https?://[^/:?#]+(?::[0-9]+)?(.*)$', 1) AS rest FROM pages)
SELECT page_id, CASE WHEN url LIKE 'https%' THEN 's' ELSE 'h' END || '-----' || array_to_string(list_reverse(l), '.') || '.' || CASE WHEN rest = '' THEN '/' ELSE rest END AS turned, l[-2] || '.' || l[-1] AS domain FROM p""")
def url_reverse(spark, d):
    return _t(spark, d, "pages").df.select("page_id", urls.reverse(F.col("url")).alias("turned"), urls.domain(F.col("url")).alias("domain"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/?#]+/?$') AS home FROM pages")
def is_home_page(spark, d):
    return _t(spark, d, "pages").df.select("page_id", urls.is_home_page(F.col("url")).alias("home"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h, regexp_extract(url, '^https?://[^/?#]+/([^/?#]+)/', 1) AS seg FROM pages),
q AS (SELECT page_id, h, seg, h || '/' || CASE WHEN seg = '' THEN '' ELSE seg || '/' END AS l1, array_to_string(string_split(h, '.')[-2:], '.') AS dom FROM p),
t AS (SELECT l1 FROM q GROUP BY 1 HAVING count(*) >= 2)
SELECT page_id, CASE WHEN seg <> '' AND l1 IN (FROM t) THEN l1 WHEN h <> dom AND h || '/' IN (FROM t) THEN h || '/' ELSE dom || '/' END AS site FROM q""")
def site_lookup(spark, d):
    """Sites by a table of prefixes: here, hosts and first path segments with two pages or more."""
    pages = _t(spark, d, "pages").df.select("page_id", "url")
    prefixes = pages.groupBy(urls.first_path(F.col("url")).alias("prefix")).count().where("count >= 2")
    return urls.site(pages, "url", prefixes).select("page_id", "site")


@query("""SELECT DISTINCT CASE WHEN url LIKE 'https%' THEN 's' ELSE 'h' END || '-----' || array_to_string(list_reverse(string_split(regexp_extract(url, '^https?://([^/:?#]+)', 1), '.')), '.') || '.'
|| CASE WHEN regexp_extract(url, '^https?://[^/:?#]+(.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/:?#]+(.*)$', 1) END AS url FROM pages""")
def url_list_load(spark, d):
    lines = _t(spark, d, "pages").df.select(F.concat(F.lit(" "), "url", F.lit(" ")).alias("value"))
    return urls.url_list(lines.unionByName(lines.select(F.lit("  ").alias("value"))))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 0 END AS code FROM documents")
def language_codes(spark, d):
    return _t(spark, d, "documents").df.select("doc_id", lookups.mapped(F.upper("lang"), {"en": 1, "de": 2, "fr": 3}, 0).alias("code"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_custkey WHEN c_nationkey % 3 = 0 THEN 1000000 + c_nationkey
ELSE 2000000 END::BIGINT AS quota FROM customer""")
def inherited_settings(spark, d):
    customers = _t(spark, d, "customer").df.select("c_custkey", "c_nationkey")
    own = customers.where("c_custkey % 7 = 0").select("c_custkey", F.col("c_custkey").alias("quota"))
    nation = _t(spark, d, "nation").df.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") + 1_000_000).cast("long").alias("quota"))
    everyone = spark.range(1).select(F.lit(2_000_000).cast("long").alias("quota"))
    return lookups.inherited(customers, "quota", [(own, ["c_custkey"]), (nation, ["c_nationkey"]), (everyone, [])]).select("c_custkey", "quota")


class _NationRows:
    """Each part reads its share of a file's rows."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, part: int, parts: int):
        import pyarrow.parquet as pq

        rows = pq.read_table(self.path, columns=["n_nationkey", "n_name"]).to_pandas()
        yield rows[rows.index % parts == part]


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def user_source(spark, d):
    """A source of the user's own over a table's file."""
    path = "/" + _t(spark, d, "nation").df.inputFiles()[0].removeprefix("file:").lstrip("/")
    return readers.user_source(spark, _NationRows(path), "n_nationkey long, n_name string", "n_nationkey").df


@query("SELECT o_custkey, bit_or(1::BIGINT << (o_orderkey % 40)::INT) AS any, bit_and(o_orderkey) AS every FROM orders GROUP BY 1")
def bitmask_merge(spark, d):
    return _t(spark, d, "orders").df.groupBy("o_custkey").agg(F.bit_or(bits.bit(F.col("o_orderkey") % 40)).alias("any"), F.bit_and("o_orderkey").alias("every"))


@query("SELECT o_orderkey, greatest(date_diff('day', DATE '2009-01-01', o_orderdate::DATE), 0)::INTEGER AS version FROM orders")
def day_version(spark, d):
    return _t(spark, d, "orders").df.select("o_orderkey", dates.day_version(F.col("o_orderdate").cast("date")).alias("version"))


@query("SELECT event_id, CASE WHEN a <= 20 THEN a WHEN a <= 30 THEN a // 2 * 2 WHEN a <= 80 THEN a // 5 * 5 WHEN a <= 120 THEN a // 10 * 10 ELSE a // 15 * 15 END::BIGINT AS age FROM (SELECT event_id, event_id % 400 AS a FROM events)")
def quantize_age(spark, d):
    return _t(spark, d, "events").df.select("event_id", dates.quantize_age(F.col("event_id") % 400).alias("age"))


@query("SELECT o_orderkey, greatest(0, least(65535, floor(ln(ln(o_totalprice / 1000000 + exp(1))) * 65535 / ln(ln(1.1 + exp(1))))))::INTEGER AS rank FROM orders")
def score_64k(spark, d):
    return _t(spark, d, "orders").df.select("o_orderkey", segments.rank_64k(F.col("o_totalprice") / 1000000).alias("rank"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE exp(-2 * (1 - l_discount / 0.05)) END, 6)::DOUBLE AS penalty FROM lineitem")
def sampling_penalty(spark, d):
    return _t(spark, d, "lineitem").df.select("l_orderkey", "l_linenumber", F.round(segments.sampling_penalty(F.col("l_discount"), 0.05), 6).alias("penalty"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\x00-\\x08\\x0A-\\x0D\\x20]+', ' ', 'g'), ' ') AS key FROM documents")
def key_normalize(spark, d):
    return _t(spark, d, "documents").df.select("doc_id", text.normalize_key(F.col("text")).alias("key"))


@query("SELECT o_custkey, lpad(sum(o_orderkey)::BIGINT::VARCHAR, greatest(12, length(sum(o_orderkey)::BIGINT::VARCHAR))::INT, '0') AS line FROM orders GROUP BY 1")
def count_text_format(spark, d):
    return _t(spark, d, "orders").df.groupBy("o_custkey").agg(text.count_text(F.sum("o_orderkey")).alias("line"))


@query("SELECT p_partkey, regexp_matches(x, '^[0-9,]*\\.?[0-9,]*$') AND regexp_matches(x, '[0-9]') AS number FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_retailprice::VARCHAR ELSE p_name END AS x FROM part)")
def is_a_number(spark, d):
    return _t(spark, d, "part").df.select("p_partkey", text.is_a_number(F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice").cast("string")).otherwise(F.col("p_name"))).alias("number"))


@query("SELECT page_id, CASE WHEN regexp_matches(u, '(^|[^0-9A-Za-z])2011-0[1-9]-1[0-9]([^0-9A-Za-z]|$)') THEN 20110000 + (page_id % 9 + 1) * 100 + 10 + page_id % 10 END::INTEGER AS day FROM (SELECT page_id, 'http://a.b/2011-0' || (page_id % 9 + 1) || '-1' || (page_id % 10) || CASE WHEN page_id % 2 = 0 THEN '/x' ELSE 'x' END AS u FROM pages)")
def url_date(spark, d):
    u = F.concat(F.lit("http://a.b/2011-0"), F.col("page_id") % 9 + 1, F.lit("-1"), F.col("page_id") % 10, F.when(F.col("page_id") % 2 == 0, "/x").otherwise("x"))
    return _t(spark, d, "pages").df.select("page_id", urls.url_date(u).alias("day"))


@query("SELECT o_custkey, i AS position, sum((o_orderkey >> i::INT) & 1)::BIGINT AS total, count(*)::BIGINT AS agg_count FROM orders, range(8) t(i) GROUP BY ALL")
def segment_aggregate(spark, d):
    df = _t(spark, d, "orders").df.select("o_custkey", bits.bit_array(F.col("o_orderkey"), 8).alias("scores"))
    return reduction.positions(df, "scores", ["o_custkey"]).select("o_custkey", F.col("position").cast("long").alias("position"), "total", "agg_count")


@query("SELECT c_mktsegment, count(*)::BIGINT AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, min(c_acctbal) AS least, max(c_acctbal) AS greatest, round(stddev_samp(c_acctbal), 4) AS deviation, round(var_pop(c_acctbal), 2) AS variance FROM customer GROUP BY 1")
def column_statistics(spark, d):
    out = vectors.summary(_t(spark, d, "customer").df, "c_acctbal", ["c_mktsegment"])
    return out.select("c_mktsegment", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "least", "greatest", F.round("deviation", 4).alias("deviation"), F.round("variance", 2).alias("variance"))


@query("SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo), 6) AS rescaled, round((s_acctbal - m) / sd, 6) AS whitened FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi, avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS sd FROM supplier)")
def rescale_whiten(spark, d):
    return _rounded(vectors.whitened(vectors.rescaled(_t(spark, d, "supplier").df, "s_acctbal", 0.0, 1.0), "s_acctbal").select("s_suppkey", "rescaled", "whitened"), "rescaled", "whitened")


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 5) AS squared FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distance(spark, d):
    a = _t(spark, d, "embeddings").df.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.squared_distance(F.col("x"), F.col("y")), 5).alias("squared"))


@query("SELECT p_partkey, round(2 * p_size + 1.0, 6)::DOUBLE AS lin, round(0.5 * ln(p_size + 1) + 1, 6) AS log, round(3.0 * p_size / (p_size + 10), 6)::DOUBLE AS rat, (p_size >= 10 AND p_size < 20)::INT::DOUBLE AS buck FROM part")
def feature_transforms(spark, d):
    x = F.col("p_size").cast("double")
    return _rounded(_t(spark, d, "part").df.select("p_partkey", transforms.linear(x, 2.0, 1.0).alias("lin"), transforms.log_linear(x, 0.5, 1.0).alias("log"), transforms.rational(x, 3.0, 0.0, 10.0).alias("rat"), transforms.bucket(x, 10, 20).alias("buck")), "lin", "log", "rat")


@query("""WITH f AS (SELECT count(*) FILTER (text LIKE '%the%')::DOUBLE AS n1, count(*) FILTER (text LIKE '%ing%')::DOUBLE AS n2, count(*)::DOUBLE AS n, avg(n_chars) AS m FROM documents),
t AS (SELECT doc_id, n_chars, (length(text) - length(replace(text, 'the', ''))) // 3 AS a, (length(text) - length(replace(text, 'ing', ''))) // 3 AS b FROM documents),
s AS (SELECT doc_id, a / (1 + 0.5 * (n_chars / m - 1)) AS ta, b / (1 + 0.5 * (n_chars / m - 1)) AS tb, CASE WHEN n1 < n * 2 THEN ln((n * 4 - n1 + 0.5) / (n1 + 0.5)) ELSE 0 END AS ia, CASE WHEN n2 < n * 2 THEN ln((n * 4 - n2 + 0.5) / (n2 + 0.5)) ELSE 0 END AS ib FROM t, f)
SELECT doc_id, round(ia * ta / (1.2 + ta) + ib * tb / (1.2 + tb), 5) AS score FROM s""")
def bm25f(spark, d):
    docs = _t(spark, d, "documents").df
    words = ("the", "ing")
    stats = docs.agg(*[F.sum(F.col("text").contains(w).cast("long")).alias(f"n_{w}") for w in words], F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("m")).first()
    count = lambda w: (F.length("text") - F.length(F.replace("text", F.lit(w), F.lit("")))) / len(w)
    tf = F.array(*[transforms.field_tf([count(w)], [F.col("n_chars")], [1.0], [stats.m], [0.5]) for w in words])
    idf = F.array(*[transforms.idf(F.lit(float(stats[f"n_{w}"])), 4.0 * stats.n) for w in words])
    return docs.select("doc_id", F.round(transforms.bm25f(tf, idf), 5).alias("score"))


# --- Streams, training and search (held to brute force in the tests)


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    df = _t(spark, d, "events").df.select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return windows.windowed(df, "ts", ["event_type"], "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def boost_train(spark, d):
    rows = _t(spark, d, "part").df.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), (F.length("p_name") % 7).cast("double").alias("name"), F.col("p_retailprice").alias("label"))
    model = boost.train(rows, ["p_size", "name"], "label", boost.Settings(trees=4, leaves=4))
    return model.predict(rows).select("p_partkey", "label", F.round("score", 6).alias("score"))


@query()
def find_step(spark, d):
    return findstep.best_step(_ranked(spark, d).withColumn("step", F.col("tie") % 10 * -1.0), "q", "label", "score", "step", 0.0, 5.0, 3)


from rankflow import more_queries, source_queries  # noqa: E402, F401  register their queries here
