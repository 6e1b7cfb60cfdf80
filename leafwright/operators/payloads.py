"""JSON payloads: tolerant parsing, pruning for models, nested outlines, citations found in them; and indexes kept as tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import stage_root
from ..sources.derived import PAGES, TOC, page_text, toc_items
from ..sources.tables import load

#: Keys that no model is shown, and the bounds of what it is.
HIDDEN = {"image_path", "file_path", "embedding", "password", "api_key"}
MOST_ITEMS, MOST_CHARS, MOST_DEPTH = 8, 1500, 6
#: What an upload may be.
SUFFIXES, MOST_BYTES = ("pdf", "txt", "md", "markdown", "csv", "tsv", "xlsx", "docx", "pptx"), 50 << 20


def parse_loose(text: str | None):
    """PRJ22: the JSON in a model's answer: whole, without its fence, or its first balanced part, stray commas mended; None without any."""
    s = re.sub(r"^```(?:json)?\s*\n?|\n?```\s*$", "", (text or "").strip()).strip()
    try:
        return json.loads(s)
    except ValueError:
        pass
    for opened, closed in ("{}", "[]"):
        start, depth = s.find(opened), 0
        for m in re.finditer(re.escape(opened) + "|" + re.escape(closed), s[start:] if start >= 0 else ""):
            depth += 1 if m[0] == opened else -1
            if not depth:
                part = re.sub(r",\s*([}\]])", r"\1", s[start : start + m.end()])
                try:
                    return json.loads(re.sub(r"}\s*{", "},{", part))
                except ValueError:
                    break
    return None


def shorten(text: str, most: int = MOST_CHARS) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


def prune(value, items: int = MOST_ITEMS, chars: int = MOST_CHARS, depth: int | None = None):
    """PRJ12, PRJ13: a payload without hidden and encoded keys or empty values; lists, texts and, if told, depth are bounded."""
    if depth == 0 and isinstance(value, (dict, list)):
        return None
    below = None if depth is None else depth - 1
    if isinstance(value, dict):
        kept = {k: prune(v, items, chars, below) for k, v in value.items() if k.lower() not in HIDDEN and not k.lower().endswith("_base64")}
        return {k: v for k, v in kept.items() if v not in (None, "", [], {})}
    if isinstance(value, list):
        return [v for x in value[:items] if (v := prune(x, items, chars, below)) not in (None, "", [], {})]
    return shorten(value, chars) if isinstance(value, str) else value


def without_keys(value, keys: set[str]):
    """PRJ21: a payload without the given keys, however deep."""
    if isinstance(value, dict):
        return {k: without_keys(v, keys) for k, v in value.items() if k not in keys}
    return [without_keys(v, keys) for v in value] if isinstance(value, list) else value


def reordered(value: dict, order: list[str]) -> dict:
    """PRJ21: the keys of ``order`` that are there, in that order; others go."""
    return {k: value[k] for k in order if k in value}


def citations(value, depth: int = 5, about: dict | None = None) -> Iterator[dict]:
    """FN27: the citations of a nested payload, down to ``depth``; what they lack is taken from the objects around them."""
    if depth < 0 or not isinstance(value, (dict, list)):
        return
    if isinstance(value, list):
        for x in value:
            yield from citations(x, depth - 1, about)
        return
    about = {**(about or {}), **{k: value[k] for k in ("document_id", "document_name", "page") if value.get(k)}}
    if value.get("snippet") and about.get("document_id"):
        yield {**about, "snippet": value["snippet"]}
    for k, x in value.items():
        if isinstance(x, (dict, list)) and k != "source_anchor":
            yield from citations(x, depth - 1, about)


def nested(rows: list[dict], most: int = 300) -> list[dict]:
    """PRJ10, PRJ11: rows in pre-order with levels as a tree of compact nodes."""
    roots, open_ = [], []
    for r in rows:
        node = {"node_id": f"{r['ord']:04d}", "title": r["title"], "start_page": r["page"], "summary": (r.get("summary") or "")[:most], "children": []}
        while open_ and open_[-1][0] >= r["level"]:
            open_.pop()
        (open_[-1][1]["children"] if open_ else roots).append(node)
        open_.append((r["level"], node))
    return roots


def mapped_json(text: Column, rule: Callable) -> Column:
    """``rule`` applied to a column of JSON, in Arrow batches; null where it is none, or becomes none."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        made = (None if v is None else rule(v) for v in map(parse_loose, s))
        return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=False) for v in made], dtype=object)

    return run(text)


def outline_json(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A document's outline as one JSON text; its nodes meet in one group, whose size is an outline's."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        rows = f.sort_values("ord")[["ord", "title", "page", "level"]].to_dict("records")
        rows = [{**r, "ord": int(r["ord"]), "page": int(r["page"])} for r in rows]
        return pd.DataFrame([(key[0], json.dumps(nested(rows), ensure_ascii=False))], columns=[doc, "outline"])

    return items.groupBy(doc).applyInPandas(run, f"{doc} long, outline string")


def found_citations(payloads: DataFrame, key: list[str], text: str) -> DataFrame:
    """A row for each citation of each payload, in order, each once for its document, page and snippet."""
    schema = "array<struct<document_id:string,document_name:string,page:string,snippet:string>>"

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.Series:
        names = ("document_id", "document_name", "page", "snippet")
        row = lambda c: {n: None if c.get(n) is None else str(c[n]) for n in names}
        return pd.Series([[row(c) for c in citations(parse_loose(t))] for t in s])

    d = payloads.select(*key, F.posexplode(F.array_distinct(run(text))).alias("place", "c"))
    return d.select(*key, "place", "c.*")


def save_index(nodes: DataFrame, path: str, doc: str = "doc_id", buckets: int = 256) -> None:
    """SNK01: outlines as a table in folders by a document's bucket, so that one document's is found without reading all."""
    nodes.withColumn("bucket", F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").mode("append").parquet(path)


def load_index(spark: SparkSession, path: str, doc_id: int, doc: str = "doc_id", buckets: int = 256) -> DataFrame | None:
    """SRC13: a document's outline; None where there is no such table or document."""
    try:
        d = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    key = spark.range(1).select(F.pmod(F.xxhash64(F.lit(doc_id).cast("long")), F.lit(buckets)).cast("int")).first()[0]
    found = d.where((F.col("bucket") == key) & (F.col(doc) == doc_id)).drop("bucket")
    return found if found.limit(1).count() else None


def accepted_upload(name: Column, size: Column) -> Column:
    """SNK02: null where a file may be stored, else why not: its suffix, or 50 MB and more."""
    suffix = F.lower(F.regexp_extract(name, r"\.(\w+)$", 1))
    return F.when(~suffix.isin(*SUFFIXES), "unsupported_type").when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > MOST_BYTES, "too_large")


def content_blocks(text: DataFrame, key: str = "doc_id") -> DataFrame:
    """SRC10: blocks to preview a text by: headings, list items, table rows and paragraphs, a line each."""
    line = F.trim("line")
    kind = F.when(line.rlike("^#{1,6}\\s"), "heading").when(line.rlike(r"^([-*+]|\d+[.)])\s"), "list_item").when(line.rlike(r"^\|.*\|$"), "table_row").otherwise("paragraph")
    d = text.select(key, F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return d.where(line != "").select(key, (F.col("p") + 1).alias("start_line"), kind.alias("kind"), line.alias("text"))


_LOOSE = "case event_id % 5 when 0 then '```json\n' || props || '\n```' when 1 then 'Here: {\"a\": [1, 2,], } thanks' when 2 then 'none' when 3 then '[{\"a\":1} {\"a\":2}]' else props end"


@query("prj22_loose_json", "SELECT event_id, CASE event_id % 5 WHEN 1 THEN '{\"a\":[1,2]}' WHEN 2 THEN NULL WHEN 3 THEN '{\"a\":1}' ELSE replace(props, ' ', '') END AS parsed FROM events")
def _prj22(spark, d):
    return load(spark, d, "events").select("event_id", mapped_json(F.expr(_LOOSE), lambda v: v).alias("parsed"))


@query("prj12_pruned", "SELECT event_id, '{\"n\":[1,2,3,4,5,6,7,8],\"t\":\"' || repeat('x', 1497) || '...\"}' AS pruned FROM events")
def _prj12(spark, d):
    text = F.expr("'{\"n\":[1,2,3,4,5,6,7,8,9,10],\"t\":\"' || repeat('x', 2000) || '\",\"Image_BASE64\":\"zz\",\"password\":\"p\",\"e\":[],\"f\":{\"g\":\"\"}}'")
    return load(spark, d, "events").select("event_id", mapped_json(text, prune).alias("pruned"))


@query("prj13_compacted", "SELECT event_id, '{\"a\":{\"a\":{\"t\":\"' || repeat('y', 497) || '...\"}}}' AS compacted FROM events")
def _prj13(spark, d):
    text = F.expr("'{\"a\":{\"a\":{\"t\":\"' || repeat('y', 600) || '\",\"a\":{\"a\":1}}}}'")
    return load(spark, d, "events").select("event_id", mapped_json(text, lambda v: prune(v, 8, 500, 3)).alias("compacted"))


@query("prj21_fields", "SELECT event_id, '{\"b\":{\"t\":1},\"a\":2}' AS fields FROM events")
def _prj21(spark, d):
    return load(spark, d, "events").select("event_id", mapped_json(F.lit('{"a":2,"text":"x","b":{"text":"y","t":1},"c":3}'), lambda v: reordered(without_keys(v, {"text"}), ["b", "a", "z"])).alias("fields"))


@query("prj10_compact_tree")
def _prj10(spark, d):
    return outline_json(toc_items(spark, d))


@query("prj11_outline_roots", f"WITH {TOC}, m AS (SELECT *, min(level) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ti) SELECT doc_id, count(*) FILTER (before IS NULL OR level <= before) AS roots FROM m GROUP BY 1")
def _prj11(spark, d):
    o = outline_json(toc_items(spark, d))
    return o.select("doc_id", F.json_array_length("outline").cast("long").alias("roots"))


@query("fn27_citations", "SELECT conv_id, turn, 0 AS place, 'd' || conv_id AS document_id, CAST(NULL AS VARCHAR) AS document_name, CAST(turn + 1 AS VARCHAR) AS page, 's' AS snippet FROM conversations UNION ALL SELECT conv_id, turn, 1, 'd' || conv_id, 'n', CAST(turn + 2 AS VARCHAR), 't' FROM conversations")
def _fn27(spark, d):
    text = F.expr("'{\"document_id\":\"d' || conv_id || '\",\"page\":' || (turn + 1) || ',\"hits\":[{\"snippet\":\"s\"},{\"snippet\":\"s\"},{\"x\":{\"document_name\":\"n\",\"page\":' || (turn + 2) || ',\"snippet\":\"t\"}}],\"q\":{\"w\":{\"e\":{\"r\":{\"t\":{\"y\":{\"snippet\":\"deep\"}}}}}}}'")
    c = load(spark, d, "conversations").select("conv_id", "turn", text.alias("payload"))
    return found_citations(c, ["conv_id", "turn"], "payload")


@query("src13_load_index", f"WITH {TOC} SELECT doc_id, ord, title, page FROM ti WHERE doc_id = 7")
def _src13(spark, d):
    """SNK01, SRC13: all outlines stored, one document's read back."""
    path = f"{stage_root(spark)}/index-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    if load_index(spark, path, 7) is None:
        save_index(toc_items(spark, d), path)
    return load_index(spark, path, 7).select("doc_id", "ord", "title", "page")


@query("snk02_uploads", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'unsupported_type' WHEN c_custkey % 4 = 1 AND c_custkey % 3 = 0 THEN 'empty' WHEN c_custkey % 4 = 2 AND c_custkey % 3 = 1 THEN 'too_large' END AS refused FROM customer")
def _snk02(spark, d):
    name = F.expr("c_name || case c_custkey % 4 when 0 then '.exe' when 1 then '.PDF' when 2 then '.csv' else '.tar.md' end")
    size = F.expr("case when c_custkey % 4 = 1 and c_custkey % 3 = 0 then 0 when c_custkey % 4 = 2 and c_custkey % 3 = 1 then 52428801 else 52428800 end")
    return load(spark, d, "customer").select("c_custkey", accepted_upload(name, size).alias("refused"))


@query("src10_blocks", rf"WITH {PAGES}, l AS (SELECT doc_id, page, trim(CASE page % 4 WHEN 0 THEN '## ' || text WHEN 1 THEN '- ' || text WHEN 2 THEN '| ' || text || ' |' ELSE text END) AS t FROM pg) SELECT doc_id, page AS start_line, CASE WHEN regexp_matches(t, '^#{{1,6}}\s') THEN 'heading' WHEN regexp_matches(t, '^([-*+]|\d+[.)])\s') THEN 'list_item' WHEN regexp_matches(t, '^\|.*\|$') THEN 'table_row' ELSE 'paragraph' END AS kind, t AS text FROM l WHERE t <> ''")
def _src10(spark, d):
    line = F.expr("case page % 4 when 0 then '## ' || text when 1 then '- ' || text when 2 then '| ' || text || ' |' else text end")
    t = page_text(spark, d).select("doc_id", "page", line.alias("l")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "l"))), lambda x: x.l), "\n").alias("text"))
    return content_blocks(t)
