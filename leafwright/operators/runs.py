"""Runs, conversations, settings and citations: joins, orders, changes and summaries of stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.derived import FILES, FOLDERS, PAGES, TOC, files, folders, page_text, toc_items
from ..sources.tables import load
from .citations import keep_first
from .records import allowed, first_user_titles

#: The order of a run's events, answer deltas apart.
HAPPY_PATH = ("session_started", "intent_start", "intent_done", "retrieval_start", "retrieval_done", "answer_done", "citations_ready", "done")


def owned_runs(runs: DataFrame, conversations: DataFrame, user: str, key: str) -> DataFrame:
    """JON01: the runs in conversations of ``user``."""
    return runs.join(conversations.where(F.col("user_id") == user).select(key), key, "left_semi")


def routed(routes: DataFrame, providers: DataFrame, key: str, name: str, fallback: str = "environment") -> DataFrame:
    """JON03: each route's provider, ``fallback`` where it has none that is enabled."""
    p = providers.where("enabled").select(key, F.col(name).alias("provider"))
    return routes.join(p, key, "left").withColumn("provider", F.coalesce("provider", F.lit(fallback)))


def recognizer(docs: DataFrame, profiles: DataFrame, key: str, task: str, default: Column) -> DataFrame:
    """JON04: the profile a document names, else the default one if capable of the task, else ``virtual``."""
    p = profiles.select(F.col("profile_id").alias("__p"), F.col("capabilities").alias("__c"))
    q = p.select(F.col("__p").alias("__q"), F.col("__c").alias("__qc"))
    j = docs.join(p, F.col(key) == F.col("__p"), "left").withColumn("__dk", default).join(q, F.col("__dk") == F.col("__q"), "left")
    chosen = F.coalesce(F.col("__p").cast("string"), F.when(F.array_contains("__qc", task), F.col("__q").cast("string")), F.lit("virtual"))
    return j.withColumn("profile", chosen).drop("__p", "__c", "__q", "__qc", "__dk")


def resolve_names(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """JON16: what is asked for as an id, else as an exact name: found, missing or ambiguous."""
    ids = docs.select(F.col("id").cast("string").alias("asked"), F.col("id").alias("by_id"))
    names = docs.groupBy(F.col("name").alias("asked")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("by_name"))
    j = asked.join(ids, "asked", "left").join(names, "asked", "left")
    one = F.coalesce("by_id", F.when(F.col("n") == 1, F.col("by_name")))
    return j.select("asked", one.alias("id"), F.when(one.isNotNull(), "found").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("outcome"))


def mentions(questions: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """JON17: which names each question contains, cases alike.

    A question's substrings of the lengths that names have meet the names by an equal join;
    the lengths are at most 255, one array for all rows.
    """
    n = names.withColumn("__k", F.lower(F.trim(name))).where(F.char_length("__k").between(1, 255))
    lengths = n.agg(F.collect_set(F.char_length("__k"))).scalar()
    t = F.lower(F.col(text))
    q = questions.withColumn("__l", lengths).withColumn("__n", F.explode("__l")).where(F.char_length(t) >= F.col("__n"))
    q = q.withColumn("__i", F.explode(F.expr(f"sequence(1, char_length({text}) - __n + 1)"))).withColumn("__k", F.substr(t, F.col("__i"), F.col("__n")))
    return q.drop("__l", "__n", "__i").distinct().join(n, "__k").drop("__k")


def cited_evidence(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """JON18: each citation's best evidence: 100 for the label, 50 for the document, 30 for the position, 10 for an id.

    Whatever scores shares a label or a document, so those two equal joins find all candidates.
    """
    e = evidence.select(F.col("evidence_id"), F.col("label").alias("__l"), F.col("doc_id").alias("__d"), F.col("position").alias("__p"))
    by_label = citations.join(e, F.col("label") == F.col("__l"))
    by_doc = citations.join(e, (F.col("doc_id") == F.col("__d")) & ~F.col("label").eqNullSafe(F.col("__l")))
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(F.col("label").eqNullSafe(F.col("__l")), 100) + points(F.col("doc_id") == F.col("__d"), 50) + points(F.col("position") == F.col("__p"), 30) + points(F.col("evidence_id").isNotNull(), 10)
    w = W.partitionBy("citation_id").orderBy(F.desc("score"), "evidence_id")
    return by_label.unionByName(by_doc).withColumn("score", score).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__l", "__d", "__p")


def merge_skeleton(headings: DataFrame, chapters: DataFrame, doc: str = "doc_id") -> DataFrame:
    """JON23: outer join by structure; headings win, and a chapter no heading names starts at its first child."""
    child = headings.withColumn("__c", F.split_part("structure", F.lit("."), F.lit(1))).where("structure like '%.%'").groupBy(doc, "__c").agg(F.min("page").alias("__first"))
    c = chapters.select(doc, "structure", F.col("title").alias("__t")).join(child.withColumnRenamed("__c", "structure"), [doc, "structure"], "left")
    j = headings.join(c, [doc, "structure"], "full")
    return j.withColumn("title", F.coalesce("title", "__t")).withColumn("page", F.coalesce("page", "__first")).drop("__t", "__first")


def weighted_mean(reports: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """AGG13: values by weight, 0 where there is none."""
    g = reports.groupBy(key).agg(F.sum(F.col(value) * F.col(weight)).alias("x"), F.sum(weight).alias("w"))
    return g.select(key, F.round(F.coalesce(F.col("x") / F.nullif(F.col("w"), F.lit(0)), F.lit(0.0)), 4).alias("mean"))


def merge_reports(reports: DataFrame, key: str) -> DataFrame:
    """AGG14, ADD05: passed where all parts are, warned where any is, reasons together, items summed."""
    return reports.groupBy(key).agg(F.bool_and("passed").alias("passed"), F.bool_or("warned").alias("warned"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.sum("items").alias("items"))


def valid_order(events: DataFrame, run: str, order: list[str], kind: str = "event_type") -> DataFrame:
    """WIN19, STR05: whether a run's events are the happy path, or part of it and then an error.

    Events become letters, so the order is one pattern. Warnings are ignored; answer deltas
    may come between the end of retrieval and that of the answer.
    """
    letter = F.create_map(*[F.lit(x) for i, e in enumerate(HAPPY_PATH) for x in (e, chr(97 + i))], F.lit("answer_delta"), F.lit("D"), F.lit("error"), F.lit("X"))
    e = events.where(F.col(kind) != "warn").withColumn("__l", F.coalesce(F.try_element_at(letter, F.col(kind)), F.lit("?")))
    s = e.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(*order, "__l"))).alias("s"))
    path = F.array_join(F.transform("s", lambda x: x["__l"]), "")
    return s.select(run, path.rlike("^(abcdeD*fgh|(a(b(c(d(e(D*(f(gh?)?)?)?)?)?)?)?)?X)$").alias("valid"))


def listed(docs: DataFrame, part: int, size: int) -> DataFrame:
    """SRT01: a page of documents, latest first, each with the count of all."""
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    return docs.orderBy(F.desc("updated"), "id").offset((part - 1) * size).limit(size).withColumn("total", total.scalar())


def message_order(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """SRT02: places by sequence, those without one last, then by id."""
    return messages.withColumn("place", F.row_number().over(W.partitionBy(conv).orderBy(F.coalesce("sequence", F.lit(999999)), "id")))


def explicit_order(items: DataFrame, doc: str = "doc_id", order: str = "ord", marker: str = "marker") -> DataFrame:
    """SRT08: by the items' own numbers where all have one, distinct and without a gap; else as they are."""
    w = W.partitionBy(doc)
    n = F.count(F.lit(1)).over(w)
    first = F.row_number().over(W.partitionBy(doc, marker).orderBy(order)) == 1
    d = items.withColumn("__f", (first & F.col(marker).isNotNull()).cast("int"))
    ok = (F.sum("__f").over(w) == n) & (F.max(marker).over(w) - F.min(marker).over(w) + 1 == n)
    d = d.withColumn("__k", F.when(ok, F.col(marker)).otherwise(F.col(order)))
    return d.withColumn("place", F.row_number().over(W.partitionBy(doc).orderBy("__k", order))).drop("__f", "__k")


def by_relevance(items: DataFrame, score: str, recency: str, key: str) -> DataFrame:
    """SRT09: by falling score and recency where any scores at all, else by recency."""
    any_ = F.max(score).over(W.partitionBy(key)) > 0
    d = items.withColumn("__s", F.when(any_, F.col(score)).otherwise(F.lit(0)))
    return d.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("__s"), recency))).drop("__s")


def preferred(models: DataFrame, markers: list[str], key: str, model: str) -> DataFrame:
    """SRT11: the model that holds the first marker any does, the least of equals; the least of all without one."""
    rank = F.coalesce(*[F.when(F.contains(F.lower(model), F.lit(m)), i) for i, m in enumerate(markers)], F.lit(len(markers)))
    return models.groupBy(key).agg(F.min_by(model, F.struct(rank, F.col(model))).alias("model"))


def verified(candidates: DataFrame, key: str, most: int = 3) -> DataFrame:
    """FLT19, SRT12: without those refuted at over 0.7 (the best stays if all are), the top by relevance x max(confidence, 0.1)."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("relevance"), "id"))
    refuted = ~F.col("passed") & (F.col("confidence") > 0.7)
    d = candidates.withColumn("__i", rank).withColumn("__all", F.bool_and(refuted).over(W.partitionBy(key)))
    d = d.where(~refuted | (F.col("__all") & (F.col("__i") == 1)))
    score = F.col("relevance") * F.greatest("confidence", F.lit(0.1))
    return d.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), "id"))).where(F.col("place") <= most).drop("__i", "__all")


def union_first_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """SET02, ADD15: the rows of both; of a key in both the first side's."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(first.columns))


def citation_key(url: Column, doc: Column, name: Column, unit: Column, start: Column, end: Column) -> Column:
    """SET03: what makes two citations one: the page on the web, or document and place."""
    anchor = F.concat_ws("|", F.coalesce(unit, F.lit("")), F.coalesce(start.cast("string"), F.lit("")), F.coalesce(end, start).cast("string"))
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.when(url.isNotNull() & (url != ""), F.concat(F.lit("web|"), url)).when(doc.isNotNull(), F.concat_ws("|", F.lit("id"), doc.cast("string"), anchor)).otherwise(F.concat_ws("|", F.lit("name"), stem, anchor))


def numbered_sources(results: DataFrame, key: str, url: str, order: str) -> DataFrame:
    """SET05: distinct addresses of a run in order of first use, from 1."""
    d = results.groupBy(key, url).agg(F.min(order).alias("__o"))
    return d.withColumn("number", F.row_number().over(W.partitionBy(key).orderBy("__o", url))).drop("__o")


def replace_on_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SET10: old rows but those whose key, nulls equal to nulls, is new; then the new."""
    n = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return old.join(n, on, "left_anti").unionByName(new)


def rate(calls: DataFrame, key: str, at: str, seconds: int, most: int) -> DataFrame:
    """STR07: calls in the ``seconds`` up to each one, and whether they are more than ``most``."""
    n = F.count(F.lit(1)).over(W.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0))
    return calls.withColumn("in_window", n).withColumn("over", n > most)


def recover_stuck(jobs: DataFrame, outputs: DataFrame, older_than: Column, key: str = "id") -> DataFrame:
    """STR09: jobs long in processing: completed if their output is there, else failed."""
    o = outputs.select(key).distinct().withColumn("__out", F.lit(True))
    stuck = F.startswith(F.col("status"), F.lit("processing:")) & older_than
    return jobs.join(o, key, "left").withColumn("status", F.when(stuck, F.when(F.col("__out"), "completed").otherwise("failed:stuck")).otherwise(F.col("status"))).drop("__out")


def delete_conversations(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """DML03: each table without the rows of conversations that go."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def move(docs: DataFrame, moves: DataFrame) -> DataFrame:
    """DML05: documents in the folders they move to."""
    m = moves.select("id", F.col("to_folder"))
    return docs.join(m, "id", "left").withColumn("folder_id", F.coalesce("to_folder", "folder_id")).drop("to_folder")


def title_defaults(conversations: DataFrame, messages: DataFrame, default: str = "New Chat") -> DataFrame:
    """DML07: conversations still under the default title take their first user message's."""
    t = first_user_titles(messages).withColumnRenamed("title", "__t")
    return conversations.join(t, "conv_id", "left").withColumn("title", F.when((F.col("title") == default) & F.col("__t").isNotNull(), F.col("__t")).otherwise(F.col("title"))).drop("__t")


def bind(attachments: DataFrame, ids: DataFrame, owner: str, message: int) -> DataFrame:
    """DML09: the owner's named attachments that aren't bound yet become the message's."""
    a = attachments.join(ids.select("id").distinct().withColumn("__n", F.lit(True)), "id", "left")
    ok = F.col("__n") & (F.col("user_id") == owner) & (F.col("status") == "pending")
    return a.withColumn("message_id", F.when(ok, F.lit(message)).otherwise(F.col("message_id"))).withColumn("status", F.when(ok, "bound").otherwise(F.col("status"))).drop("__n")


def sse_frame(name: Column, data: Column) -> Column:
    """SNK03: an event as a server-sent frame; a line of data for each line."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.replace(data, F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))


def parse_frame(frame: Column) -> Column:
    """SNK03: (event, data) of a frame, its data lines joined."""
    data = F.array_join(F.regexp_extract_all(frame, F.lit("(?m)^data: ?(.*)$"), F.lit(1)), "\n")
    return F.struct(F.regexp_extract(frame, "(?m)^event: ?(.*)$", 1).alias("event"), data.alias("data"))


def export_markdown(messages: DataFrame) -> DataFrame:
    """SNK04: a conversation as Markdown, a heading for each message."""
    m = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("m"))
    return m.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(F.lit("## "), x.role, F.lit("\n\n"), x.text)), "\n\n").alias("markdown"))


_C = "cu AS (SELECT c_custkey AS conv, c_mktsegment AS user_id FROM customer)"


@query("jon01_owned", f"WITH {_C} SELECT o_orderkey FROM orders JOIN cu ON conv = o_custkey WHERE user_id = 'BUILDING'")
def _jon01(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("conv"), F.col("c_mktsegment").alias("user_id"))
    return owned_runs(load(spark, d, "orders").withColumnRenamed("o_custkey", "conv"), c, "BUILDING", "conv").select("o_orderkey")


@query("jon03_routes", "SELECT p_partkey, coalesce(s_name, 'environment') AS provider FROM part LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 2000) ON s_suppkey = p_partkey % 15")
def _jon03(spark, d):
    s = load(spark, d, "supplier").select((F.col("s_suppkey")).alias("k"), "s_name", (F.col("s_acctbal") > 2000).alias("enabled"))
    return routed(load(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 15).alias("k")), s, "k", "s_name").select("p_partkey", "provider")


@query("jon04_recognizer", "SELECT doc_id, coalesce(CAST(p.s_suppkey AS VARCHAR), CASE WHEN q.s_suppkey % 2 = 0 THEN CAST(q.s_suppkey AS VARCHAR) END, 'virtual') AS profile FROM documents LEFT JOIN supplier p ON p.s_suppkey = doc_id % 40 LEFT JOIN supplier q ON q.s_suppkey = doc_id % 9")
def _jon04(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("profile_id"), F.expr("if(s_suppkey % 2 = 0, array('page'), array('table'))").alias("capabilities"))
    return recognizer(load(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40).alias("k")), s, "k", "page", F.col("doc_id") % 9).select("doc_id", "profile")


_NAMED = "dn AS (SELECT p_partkey AS id, p_brand || p_size % 4 AS name FROM part), ak AS (SELECT DISTINCT name AS asked FROM dn UNION SELECT CAST(s_suppkey * 60 AS VARCHAR) FROM supplier UNION SELECT s_name FROM supplier)"


@query("jon16_names", f"WITH {_NAMED}, n AS (SELECT name, count(*) AS n, min(id) AS i FROM dn GROUP BY 1) SELECT asked, coalesce(dn.id, CASE WHEN n = 1 THEN i END) AS id, CASE WHEN dn.id IS NOT NULL OR n = 1 THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome FROM ak LEFT JOIN dn ON CAST(dn.id AS VARCHAR) = asked LEFT JOIN n ON n.name = asked")
def _jon16(spark, d):
    docs = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("concat(p_brand, p_size % 4)").alias("name"))
    s = load(spark, d, "supplier")
    asked = docs.select(F.col("name").alias("asked")).union(s.select((F.col("s_suppkey") * 60).cast("string"))).union(s.select("s_name")).distinct()
    return resolve_names(asked, docs)


@query("jon17_mentions", "SELECT item_id, n_name FROM (SELECT item_id, 'Compare ' || text || ' with ' || n_name || '.pdf' AS q FROM benchmark JOIN nation ON n_nationkey = item_id % 25) x, nation n WHERE contains(lower(q), lower(n.n_name))")
def _jon17_all(spark, d):
    n = load(spark, d, "nation")
    q = load(spark, d, "benchmark").join(n.select((F.col("n_nationkey")).alias("k"), F.col("n_name").alias("m")), F.col("item_id") % 25 == F.col("k"))
    q = q.select("item_id", F.concat(F.lit("Compare "), F.col("text"), F.lit(" with "), F.col("m"), F.lit(".pdf")).alias("q"))
    return mentions(q, n.select("n_name"), "q", "n_name").select("item_id", "n_name")


_EV = "ev AS (SELECT page_id AS evidence_id, 'L' || page_id % 40 AS label, page_id % 30 AS doc_id, page_id % 4 AS position FROM pages), ci AS (SELECT item_id AS citation_id, 'L' || item_id % 50 AS label, item_id % 45 AS doc_id, item_id % 4 AS position FROM benchmark)"


_POINTS = "CASE WHEN c.label = e.label THEN 100 ELSE 0 END + CASE WHEN c.doc_id = e.doc_id THEN 50 ELSE 0 END + CASE WHEN c.position = e.position THEN 30 ELSE 0 END + 10"


@query("jon18_cited", f"WITH {_EV} SELECT citation_id, evidence_id, CAST({_POINTS} AS INT) AS score FROM ci c, ev e WHERE c.label = e.label OR c.doc_id = e.doc_id QUALIFY row_number() OVER (PARTITION BY citation_id ORDER BY {_POINTS} DESC, evidence_id) = 1")
def _jon18(spark, d):
    e = load(spark, d, "pages").selectExpr("page_id as evidence_id", "concat('L', page_id % 40) as label", "page_id % 30 as doc_id", "page_id % 4 as position")
    c = load(spark, d, "benchmark").selectExpr("item_id as citation_id", "concat('L', item_id % 50) as label", "item_id % 45 as doc_id", "item_id % 4 as position")
    return cited_evidence(c, e).select("citation_id", "evidence_id", "score")


@query("jon20_nodes", f"WITH {TOC} SELECT k.doc_id, k.ord, title FROM (SELECT doc_id, unnest([0, 2, 99]) AS ord FROM documents) k JOIN ti ON ti.doc_id = k.doc_id AND ti.ord = k.ord")
def _jon20(spark, d):
    asked = load(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(2), F.lit(99))).alias("ord"))
    return asked.join(toc_items(spark, d), ["doc_id", "ord"]).select("doc_id", "ord", "title")


@query("jon23_skeleton", f"WITH {TOC}, h AS (SELECT * FROM ti WHERE structure LIKE '%.%' AND structure NOT LIKE '%.0'), c AS (SELECT DISTINCT doc_id, split_part(structure, '.', 1) AS s FROM ti) SELECT doc_id, structure, title, page FROM h UNION ALL SELECT doc_id, s, 'Chapter ' || s, (SELECT min(page) FROM h WHERE h.doc_id = c.doc_id AND split_part(h.structure, '.', 1) = c.s) FROM c")
def _jon23(spark, d):
    t = toc_items(spark, d)
    c = t.select("doc_id", F.split_part("structure", F.lit("."), F.lit(1)).alias("structure")).distinct().withColumn("title", F.concat(F.lit("Chapter "), F.col("structure")))
    return merge_skeleton(t.where("structure not like '%.0'"), c).select("doc_id", "structure", "title", "page")


@query("agg05_folders", f"WITH {FILES} SELECT folder_id, count(*) AS n FROM fi GROUP BY 1")
def _agg05(spark, d):
    return files(spark, d).groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg06_staleness", f"WITH {FILES} SELECT user_id, count(*) AS n, max(updated) AS latest FROM fi WHERE status IN ('completed', 'indexed') GROUP BY 1")
def _agg06(spark, d):
    return files(spark, d).where("status in ('completed', 'indexed')").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("updated").alias("latest"))


@query("agg07_snapshot", f"WITH {TOC} SELECT (SELECT count(*) FROM documents) AS docs, count(*) AS segments, count(*) FILTER (doc_id % 3 = 0) AS scoped FROM ti")
def _agg07(spark, d):
    n = load(spark, d, "documents").agg(F.count(F.lit(1)).alias("docs"))
    return toc_items(spark, d).agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("doc_id") % 3 == 0).alias("scoped")).withColumn("docs", n.scalar())


@query("agg13_weighted", "SELECT l_returnflag AS kind, round(sum(l_discount * l_linenumber) / sum(l_linenumber), 4) AS mean FROM lineitem GROUP BY 1")
def _agg13(spark, d):
    return weighted_mean(load(spark, d, "lineitem").withColumnRenamed("l_returnflag", "kind"), "kind", "l_discount", "l_linenumber")


@query("agg14_merge", "SELECT l_orderkey, bool_and(l_linenumber < 4) AS passed, bool_or(l_linestatus = 'F') AS warned, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS reasons, CAST(sum(l_linenumber) AS BIGINT) AS items FROM lineitem GROUP BY 1")
def _agg14(spark, d):
    r = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") < 4).alias("passed"), (F.col("l_linestatus") == "F").alias("warned"), F.col("l_returnflag").alias("reason"), F.col("l_linenumber").alias("items"))
    return merge_reports(r, "l_orderkey")


@query("agg21_statuses", f"WITH {FILES} SELECT split_part(status, ':', 1) AS status, count(*) AS n, round(avg(updated), 2) AS mean FROM fi GROUP BY 1")
def _agg21(spark, d):
    return files(spark, d).groupBy(F.split_part("status", F.lit(":"), F.lit(1)).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("updated"), 2).alias("mean"))


@query("win02_backfill", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders")
def _win02(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("seq"))


_RUNS = "case s_suppkey % 5 when 0 then 'session_started,intent_start,intent_done,retrieval_start,retrieval_done,answer_delta,answer_delta,answer_done,citations_ready,done' when 1 then 'session_started,intent_start,done' when 2 then 'session_started,intent_start,warn,error' when 3 then 'session_started,answer_delta,intent_start,error' else 'error,session_started' end"


@query("win19_order", "SELECT s_suppkey, s_suppkey % 5 IN (0, 2) AS valid FROM supplier")
def _win19(spark, d):
    e = load(spark, d, "supplier").select("s_suppkey", F.posexplode(F.split(F.expr(_RUNS), ",")).alias("seq", "event_type"))
    return valid_order(e, "s_suppkey", ["seq"])


@query("srt01_listing", f"WITH {FILES} SELECT id, (SELECT count(*) FROM fi) AS total FROM fi ORDER BY updated DESC, id LIMIT 20 OFFSET 20")
def _srt01(spark, d):
    return listed(files(spark, d), 2, 20).select("id", "total")


@query("srt02_messages", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 4 = 1 THEN 999999 ELSE -turn END, turn) AS place FROM conversations")
def _srt02(spark, d):
    m = load(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 1, -F.col("turn")).alias("sequence"), F.col("turn").alias("id"))
    return message_order(m).select("conv_id", "turn", "place")


@query("srt08_explicit", f"WITH {TOC}, k AS (SELECT doc_id, ord, CASE WHEN doc_id % 4 = 0 AND ord = 1 THEN NULL WHEN doc_id % 4 = 1 THEN ord // 2 ELSE 100 - ord END AS m FROM ti), g AS (SELECT doc_id, count(m) = count(*) AND count(DISTINCT m) = count(*) AND max(m) - min(m) + 1 = count(*) AS ok FROM k GROUP BY 1) SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN ok THEN m ELSE ord END, ord) AS place FROM k JOIN g USING (doc_id)")
def _srt08(spark, d):
    m = F.expr("case when doc_id % 4 = 0 and ord = 1 then null when doc_id % 4 = 1 then ord div 2 else 100 - ord end")
    return explicit_order(toc_items(spark, d).withColumn("marker", m)).select("doc_id", "ord", "place")


@query("srt09_relevance", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE floor(l_discount * 20) END DESC, l_linenumber) AS place FROM lineitem")
def _srt09(spark, d):
    k = load(spark, d, "lineitem").withColumn("s", F.when(F.col("l_orderkey") % 2 == 0, F.lit(0)).otherwise(F.floor(F.col("l_discount") * 20)))
    return by_relevance(k, "s", "l_linenumber", "l_orderkey").select("l_orderkey", "l_linenumber", "place")


@query("srt11_preferred", "SELECT p_size AS k, arg_min(p_type || '-' || p_name, (CASE WHEN contains(lower(p_type || '-' || p_name), 'small') THEN 0 WHEN contains(lower(p_type || '-' || p_name), 'ec') THEN 1 ELSE 2 END, p_type || '-' || p_name)) AS model FROM part GROUP BY 1")
def _srt11(spark, d):
    m = load(spark, d, "part").select(F.col("p_size").alias("k"), F.concat_ws("-", "p_type", "p_name").alias("m"))
    return preferred(m, ["small", "ec"], "k", "m")


@query("srt12_verified", "WITH k AS (SELECT l_orderkey AS q, l_linenumber AS id, l_quantity AS rel, l_discount * 10 AS conf, l_linenumber % 3 = 0 AND l_orderkey % 3 > 0 AS passed FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rel DESC, id) AS i, bool_and(NOT passed AND conf > 0.7) OVER (PARTITION BY q) AS al FROM k), f AS (SELECT * FROM r WHERE NOT (NOT passed AND conf > 0.7) OR (al AND i = 1)) SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY rel * greatest(conf, 0.1) DESC, id) AS place FROM f QUALIFY place <= 3")
def _srt12(spark, d):
    k = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("relevance"), (F.col("l_discount") * 10).alias("confidence"), ((F.col("l_linenumber") % 3 == 0) & (F.col("l_orderkey") % 3 > 0)).alias("passed"))
    return verified(k, "q").select("q", "id", "place")


@query("set02_models", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _set02(spark, d):
    a = load(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return union_first_wins(a, load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id")


@query("set03_citations", "SELECT min(l_orderkey * 10 + l_linenumber) AS first, count(*) AS n FROM lineitem GROUP BY CASE WHEN l_linenumber = 1 THEN 'w' || l_partkey % 20 WHEN l_linenumber = 2 THEN 'i' || l_suppkey || '|' || l_partkey % 5 ELSE 'n' || l_returnflag || '|' || l_partkey % 5 END")
def _set03(spark, d):
    k = load(spark, d, "lineitem")
    url = F.expr("case when l_linenumber = 1 then concat('http://x/', l_partkey % 20) end")
    key = citation_key(url, F.expr("case when l_linenumber = 2 then l_suppkey end"), F.expr("concat(l_returnflag, if(l_linenumber % 2 = 0, '.pdf', '.PDF'))"), F.lit("page"), F.expr("l_partkey % 5"), F.lit(None).cast("bigint"))
    return k.groupBy(key.alias("k")).agg(F.min(F.expr("l_orderkey * 10 + l_linenumber")).alias("first"), F.count(F.lit(1)).alias("n")).drop("k")


@query("set05_sources", "WITH g AS (SELECT l_orderkey, 'u' || l_partkey % 3 AS url, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, url, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, url) AS number FROM g")
def _set05(spark, d):
    return numbered_sources(load(spark, d, "lineitem").withColumn("url", F.expr("concat('u', l_partkey % 3)")), "l_orderkey", "url", "l_linenumber")


@query("set10_replace", f"WITH {FILES}, n AS (SELECT DISTINCT folder_id, user_id FROM fi WHERE id % 10 = 0) SELECT id FROM fi WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.folder_id IS NOT DISTINCT FROM fi.folder_id AND n.user_id = fi.user_id) UNION ALL SELECT -id FROM fi WHERE id % 10 = 0")
def _set10(spark, d):
    f = files(spark, d).select("id", "folder_id", "user_id")
    return replace_on_key(f, f.where("id % 10 = 0").withColumn("id", -F.col("id")), ["folder_id", "user_id"]).select("id")


@query("flt02_indexed", f"WITH {FILES} SELECT id FROM fi WHERE status = 'indexed' AND user_id = 'BUILDING'")
def _flt02(spark, d):
    return files(spark, d).where("status = 'indexed' and user_id = 'BUILDING'").select("id")


@query("flt04_allowed", f"WITH {FILES} SELECT id FROM fi WHERE id IN (SELECT s_suppkey * 3 FROM supplier)")
def _flt04(spark, d):
    return allowed(files(spark, d), load(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id")), "id").select("id")


@query("str07_rate", "SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 2 AS over FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW)")
def _str07(spark, d):
    return rate(load(spark, d, "events"), "event_type", "ts", 600, 2).select("event_id", "in_window", "over")


@query("str09_stuck", f"WITH {FILES} SELECT id, CASE WHEN status LIKE 'processing:%' AND updated < 3000 THEN CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = id) THEN 'completed' ELSE 'failed:stuck' END ELSE status END AS status FROM fi")
def _str09(spark, d):
    return recover_stuck(files(spark, d), load(spark, d, "orders").select(F.col("o_custkey").alias("id")), F.col("updated") < 3000).select("id", "status")


@query("dml03_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _dml03(spark, d):
    gone = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("conv"))
    return delete_conversations({"messages": load(spark, d, "orders").withColumnRenamed("o_custkey", "conv")}, gone, "conv")["messages"].select("o_orderkey")


@query("dml05_move", f"WITH {FILES} SELECT id, CASE WHEN id % 5 = 0 THEN 'r1' ELSE folder_id END AS folder_id FROM fi")
def _dml05(spark, d):
    f = files(spark, d)
    return move(f, f.where("id % 5 = 0").select("id", F.lit("r1").alias("to_folder"))).select("id", "folder_id")


@query("dml06_status", "SELECT c_custkey AS id, coalesce(p.p_name, c_name) AS description FROM customer LEFT JOIN part p ON p_partkey = c_custkey AND p_size > 25")
def _dml06(spark, d):
    new = load(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("new"))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name").join(new, "id", "left").select("id", F.coalesce("new", "c_name").alias("description"))


@query("dml07_titles", r"WITH u AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Kept' WHEN t IS NULL THEN 'New Chat' ELSE 'changed' END AS state FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN u USING (conv_id)")
def _dml07(spark, d):
    m = load(spark, d, "conversations")
    c = m.select("conv_id").distinct().withColumn("title", F.when(F.col("conv_id") % 2 == 0, "Kept").otherwise("New Chat"))
    return title_defaults(c, m).select("conv_id", F.when(F.col("title").isin("Kept", "New Chat"), F.col("title")).otherwise("changed").alias("state"))


@query("dml09_bind", f"WITH {FILES} SELECT id, CASE WHEN ok THEN 7 END AS message_id, CASE WHEN ok THEN 'bound' ELSE st END AS status FROM (SELECT id, st, id % 2 = 0 AND user_id = 'BUILDING' AND st = 'pending' AS ok FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 'bound' ELSE 'pending' END AS st FROM fi))")
def _dml09(spark, d):
    f = files(spark, d).select("id", "user_id", F.lit(None).cast("int").alias("message_id"), F.when(F.col("id") % 3 == 0, "bound").otherwise("pending").alias("status"))
    return bind(f, f.where("id % 2 = 0"), "BUILDING", 7).select("id", "message_id", "status")


@query("snk03_frames", "SELECT event_id, event_type AS event, props || chr(10) || event_id AS data FROM events")
def _snk03(spark, d):
    e = load(spark, d, "events").select("event_id", parse_frame(sse_frame(F.col("event_type"), F.concat(F.col("props"), F.lit("\n"), F.col("event_id").cast("string")))).alias("f"))
    return e.select("event_id", "f.event", "f.data")


@query("snk04_export", "SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1")
def _snk04(spark, d):
    return export_markdown(load(spark, d, "conversations"))


@query("set04_evidence", f"WITH {PAGES}, k AS (SELECT doc_id, text, min(page) AS page FROM pg GROUP BY 1, 2) SELECT doc_id, page FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) <= 24")
def _set04(spark, d):
    k = keep_first(page_text(spark, d), [F.col("doc_id"), F.col("text")], ["page"])
    return k.withColumn("i", F.row_number().over(W.partitionBy("doc_id").orderBy("page"))).where("i <= 24").select("doc_id", "page")


@query("tool1_folders", f"WITH {FOLDERS}, {FILES} SELECT path, count(fi.id) AS n FROM fo LEFT JOIN fi USING (folder_id) GROUP BY 1")
def _tool1(spark, d):
    return folders(spark, d).join(files(spark, d), "folder_id", "left").groupBy("path").agg(F.count("id").alias("n"))
