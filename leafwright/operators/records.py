"""Relational metadata: listings, scopes, conversations, event logs and snapshot changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import FILES, FOLDERS, files, folders
from ..sources.tables import load
from .text import conversation_title


def list_documents(docs: DataFrame, user: str | None = None, folder: str | None = None, root_only: bool = True, name: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """FLT01, SRT01: a page of documents that pass every given condition, latest first."""
    d = docs
    if user is not None:
        d = d.where(F.col("user_id") == user)
    if folder is not None:
        d = d.where(F.col("folder_id") == folder)
    elif root_only:
        d = d.where(F.col("folder_id").isNull())
    if name:
        d = d.where(F.lower("name").contains(name.lower()))
    return d.orderBy(F.desc("updated"), "id").offset(offset).limit(limit)


def in_scope(path: Column, scope: str, recursive: bool) -> Column:
    """FLT03."""
    return (path == scope) | (F.lit(recursive) & path.startswith(scope.rstrip("/") + "/"))


def allowed(df: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    """FLT04: no list admits all, an empty one nothing."""
    return df if ids is None else df.join(ids, key, "left_semi")


def split_requested(asked: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """JON08: requested ids, each as selected or rejected."""
    return asked.join(docs.select(key, F.lit("selected").alias("outcome")), key, "left").withColumn("outcome", F.coalesce("outcome", F.lit("rejected")))


def status_code(status: Column) -> Column:
    """PRJ14: what follows ``failed:``."""
    return F.when(status.startswith("failed:"), F.split_part(status, F.lit(":"), F.lit(2)))


def with_children(parents: DataFrame, children: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    """JON06: each parent with its children's values in order, an empty list without any."""
    got = children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(out))
    kind = dict(children.dtypes)[value]
    return parents.join(got, key, "left").withColumn(out, F.coalesce(out, F.array().cast(f"array<{kind}>")))


def first_user_titles(messages: DataFrame) -> DataFrame:
    """DML08: a conversation's title is that of its first user message."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return messages.select("conv_id").distinct().join(first, "conv_id", "left").select("conv_id", conversation_title(F.col("t")).alias("title"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """DML01: the latest row of each key; at equal versions the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = W.partitionBy(*key).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


def truncate_from(messages: DataFrame, bounds: DataFrame, key: str = "conv_id", seq: str = "turn") -> DataFrame:
    """DML04: messages before their conversation's boundary, all where it has none."""
    return messages.join(bounds, key, "left").where(F.col("boundary").isNull() | (F.col(seq) < F.col("boundary"))).drop("boundary")


def delete_subtree(tree: DataFrame, docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """DML02: folders and documents less those in ``path`` and below it."""
    gone = tree.where(in_scope(F.col("path"), path, True)).select("folder_id")
    return tree.join(gone, "folder_id", "left_anti"), docs.join(gone, "folder_id", "left_anti")


def number_events(events: DataFrame, run: str = "user_id", order: tuple = ("ts", "event_id")) -> DataFrame:
    """WIN01: a gapless sequence from 1 within each run."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy(run).orderBy(*order)))


def replay(events: DataFrame, after: int) -> DataFrame:
    """STR02: events past a sequence number."""
    return events.where(F.col("seq") > after)


def rolling_sla(events: DataFrame, run: str, at: str, value: str, seconds: int = 300) -> DataFrame:
    """STR04, WIN18: count and mean over the last ``seconds`` of each run."""
    w = W.partitionBy(run).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n", F.count(value).over(w)).withColumn("mean", F.avg(value).over(w))


def percentiles(events: DataFrame, by: str, value: str, points: tuple = (0.95, 0.99)) -> DataFrame:
    """AGG18: interpolated percentiles to two places."""
    return events.groupBy(by).agg(*[F.round(F.percentile(value, p), 2).alias(f"p{round(p * 100)}") for p in points])


def answer_text(deltas: DataFrame, run: str, seq: str, kind: str, chunk: str) -> DataFrame:
    """STR03: chunks appended after the run's last retraction, joined in order."""
    last = F.max(F.when(F.col(kind) == "retract", F.col(seq))).over(W.partitionBy(run))
    d = deltas.withColumn("__l", F.coalesce(last, F.lit(-1))).where((F.col(seq) > F.col("__l")) & (F.col(kind) == "append"))
    return d.groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, chunk))), lambda x: x[chunk]), "").alias("answer"))


def lockouts(attempts: DataFrame, user: str, order: tuple, ok: Column, most: int = 5) -> DataFrame:
    """STR11: failures since the last success, and whether that locks the user."""
    w = W.partitionBy(user).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = attempts.withColumn("__g", F.sum(ok.cast("int")).over(w)).withColumn("__fail", (~ok).cast("int"))
    last = d.groupBy(user).agg(F.max("__g").alias("__last")).withColumnRenamed(user, "__u")
    d = d.join(last, (F.col(user) == F.col("__u")) & (F.col("__g") == F.col("__last")))
    return d.groupBy(user).agg(F.sum("__fail").alias("failures")).withColumn("locked", F.col("failures") >= most)


def latest_status(events: DataFrame, run: str, order: list[str], status: str) -> DataFrame:
    """STR06: a run's last status."""
    return events.groupBy(run).agg(F.max_by(status, F.struct(*order)).alias("status"))


@query("flt01_list", f"WITH {FILES} SELECT id, name, status FROM fi WHERE user_id = 'FURNITURE' AND folder_id IS NULL ORDER BY updated DESC, id LIMIT 20")
def _flt01(spark, d):
    return list_documents(files(spark, d), user="FURNITURE").select("id", "name", "status")


@query("flt03_scope", f"WITH {FOLDERS}, {FILES}, o AS (SELECT min(path) AS p FROM fo WHERE parent_id IS NULL) SELECT fi.id, fo.path FROM fi JOIN fo USING (folder_id), o WHERE path = p OR starts_with(path, p || '/')")
def _flt03(spark, d):
    f = folders(spark, d)
    scope = f.where("parent_id is null").agg(F.min("path").alias("p")).first().p
    return files(spark, d).join(f.select("folder_id", "path"), "folder_id").where(in_scope(F.col("path"), scope, True)).select("id", "path")


@query("jon08_requested", "SELECT k.id, CASE WHEN c.c_custkey IS NULL THEN 'rejected' ELSE 'selected' END AS outcome FROM (SELECT DISTINCT o_custkey + 50 AS id FROM orders) k LEFT JOIN customer c ON c.c_custkey = k.id")
def _jon08(spark, d):
    asked = load(spark, d, "orders").select((F.col("o_custkey") + 50).alias("id")).distinct()
    return split_requested(asked, files(spark, d))


@query("prj14_status_code", f"WITH {FILES} SELECT id, CASE WHEN status LIKE 'failed:%' THEN split_part(status, ':', 2) END AS code FROM fi")
def _prj14(spark, d):
    return files(spark, d).select("id", status_code(F.col("status")).alias("code"))


@query("jon06_children", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, coalesce((SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey), -1) AS first FROM customer")
def _jon06(spark, d):
    c = load(spark, d, "customer").select("c_custkey")
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    got = with_children(c, o.withColumn("k", F.col("o_orderkey")), "c_custkey", "k", "o_orderkey", "kids")
    return got.select("c_custkey", F.size("kids").cast("long").alias("n"), F.coalesce(F.try_element_at("kids", F.lit(1)), F.lit(-1)).alias("first"))


@query("dml08_titles", r"WITH u AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1), c AS (SELECT conv_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN u USING (conv_id)) SELECT conv_id, CASE WHEN length(t) > 32 THEN rtrim(t[1:32]) || '…' ELSE t END AS title FROM c")
def _dml08(spark, d):
    return first_user_titles(load(spark, d, "conversations"))


@query("dml01_upsert", "WITH b AS (SELECT o_orderkey AS k, o_totalprice AS v, 1 AS ver, 0 AS new FROM orders UNION ALL SELECT o_orderkey, o_totalprice + 1, o_orderkey % 3, 1 FROM orders WHERE o_orderkey % 2 = 0) SELECT k, v, ver FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY ver DESC, new DESC) = 1")
def _dml01(spark, d):
    o = load(spark, d, "orders")
    old = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit(1).cast("long").alias("ver"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("v"), (F.col("o_orderkey") % 3).alias("ver"))
    return upsert(old, new, ["k"], "ver")


@query("dml04_truncate", "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0 OR turn < 2")
def _dml04(spark, d):
    m = load(spark, d, "conversations").select("conv_id", "turn")
    return truncate_from(m, m.where("conv_id % 3 = 0").select("conv_id", F.lit(2).alias("boundary")).distinct())


@query("dml02_delete", f"WITH {FOLDERS}, {FILES}, o AS (SELECT min(path) AS p FROM fo WHERE parent_id IS NULL) SELECT id FROM fi WHERE folder_id IS NULL OR folder_id NOT IN (SELECT folder_id FROM fo, o WHERE path = p OR starts_with(path, p || '/'))")
def _dml02(spark, d):
    f = folders(spark, d)
    path = f.where("parent_id is null").agg(F.min("path").alias("p")).first().p
    return delete_subtree(f, files(spark, d), path)[1].select("id")


@query("win01_sequence", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def _win01(spark, d):
    return number_events(load(spark, d, "events")).select("event_id", F.col("seq").cast("long").alias("seq"))


@query("str02_replay", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT user_id, event_id, seq FROM n WHERE seq > 5")
def _str02(spark, d):
    return replay(number_events(load(spark, d, "events")), 5).select("user_id", "event_id", F.col("seq").cast("long").alias("seq"))


@query("str04_rolling", "SELECT event_id, count(value) OVER w AS n, round(avg(value) OVER w, 4) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW)")
def _str04(spark, d):
    return rolling_sla(load(spark, d, "events"), "user_id", "ts", "value").select("event_id", "n", F.round("mean", 4).alias("mean"))


@query("agg18_percentiles", "SELECT event_type, round(quantile_cont(value, 0.95), 2) AS p95, round(quantile_cont(value, 0.99), 2) AS p99 FROM events GROUP BY 1")
def _agg18(spark, d):
    return percentiles(load(spark, d, "events"), "event_type", "value")


_DELTA = "CASE WHEN event_id % 11 = 0 THEN 'retract' ELSE 'append' END"


@query("str03_answers", f"WITH e AS (SELECT user_id, event_id, event_type, {_DELTA} AS kind FROM events), l AS (SELECT *, coalesce(max(CASE WHEN kind = 'retract' THEN event_id END) OVER (PARTITION BY user_id), -1) AS l FROM e) SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS answer FROM l WHERE event_id > l AND kind = 'append' GROUP BY 1")
def _str03(spark, d):
    e = load(spark, d, "events").withColumn("kind", F.expr(_DELTA))
    return answer_text(e, "user_id", "event_id", "kind", "event_type")


@query("str11_lockout", "WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS ok FROM events), g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM e), l AS (SELECT *, max(g) OVER (PARTITION BY user_id) AS last FROM g) SELECT user_id, CAST(sum((NOT ok)::INT) AS BIGINT) AS failures, sum((NOT ok)::INT) >= 5 AS locked FROM l WHERE g = last GROUP BY 1")
def _str11(spark, d):
    return lockouts(load(spark, d, "events"), "user_id", ("event_id",), F.col("event_type") == "purchase")


@query("str06_status", "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def _str06(spark, d):
    return latest_status(load(spark, d, "events"), "user_id", ["event_id"], "event_type")
