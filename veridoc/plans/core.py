"""Queries over the given tables, with the SQL that must give the same rows.

``ext_`` marks extensions beyond the documented operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions import declared
from veridoc.operators import evidence, evolve, links, sampling
from veridoc.streaming.ext_events import tumbling_counts

Query = Callable[[SparkSession, str], DataFrame]

#: The closed selectors of a market search.
FAMILIES = ["carbon_steel", "stainless_steel"]
FORMS = ["sheet", "plate", "coil", "tube", "bar"]
TOPICS = ["supplier", "processing", "specification"]
SELECTORS = {"family": FAMILIES, "form": FORMS, "topic": TOPICS}

SAMPLE, SEED = 100, "audit-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "n_chars")
    return sampling.seeded_sample(docs, "id", SAMPLE, SEED, "rank").select("id", "lang", "n_chars", F.col("rank").cast("long"))


def add_column(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    once = evolve.add_column_if_absent(docs, "letter_date", "date")
    return evolve.add_column_if_absent(once, "LETTER_DATE", "string")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left")


def coverage_all_rows(spark: SparkSession, d: str) -> DataFrame:
    return evidence.coverage(labelled(spark, d), ["lang"], F.col("quality").isNotNull())


def hash_reconcile(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    return evidence.hash_reconcile(docs.select(F.sha2("text", 256).alias("h")), items.select(F.sha2("text", 256).alias("h")), "h")


def hash_identity_violations(spark: SparkSession, d: str) -> DataFrame:
    return evidence.identity_violations(table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), ["h"])


def inventory_by_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("quality").isNull(), "held").when(F.col("quality") == 1, "accepted").otherwise("failed")
    return labelled(spark, d).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def quantity_breaks(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return evidence.identity_violations(lines, ["l_orderkey", "l_linenumber"])


def selector_domain(spark: SparkSession, d: str) -> DataFrame:
    combos = declared.domain(spark, SELECTORS)
    return combos.filter(declared.in_domain(SELECTORS))


def region_links(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").withColumn("ref", F.concat(F.lit("see [["), F.col("n_regionkey"), F.lit("::geo]]")))
    return links.extract_links(nations.withColumn("n", F.concat(F.lit("n"), "n_nationkey")), "n", "ref")


def link_extraction(spark: SparkSession, d: str) -> DataFrame:
    return region_links(spark, d)


def follow_depth_1(spark: SparkSession, d: str) -> DataFrame:
    edges = region_links(spark, d).select("src", "target", F.lit("navigational").alias("kind"))
    back = edges.select(F.col("target").alias("src"), F.col("src").alias("target"), F.lit("structural").alias("kind"))
    start = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return links.follow(edges.unionByName(back), start, 1, ["navigational"])


def dangling_links(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "documents").select("source", F.col("doc_id").alias("target"))
    return links.dangling_links(edges, "target", table(spark, d, "labels").select("doc_id"), "doc_id")


def no_silent_substitution(spark: SparkSession, d: str) -> DataFrame:
    verified = labelled(spark, d).select("doc_id", F.col("quality").alias("verified"), F.when(F.col("n_chars") > 200, F.lit(1)).otherwise(F.lit(0)).alias("calculated"))
    return evidence.with_provenance(verified, "verified", "calculated")


def reconciled_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.length("text").alias("counted"))
    return evidence.reconciled_only(docs, F.col("n_chars") == F.col("counted")).select("doc_id", "lang", "n_chars")


def tool_allow_list(spark: SparkSession, d: str) -> DataFrame:
    profiles = table(spark, d, "events").groupBy(F.col("user_id").alias("profile")).agg(F.sort_array(F.collect_set("event_type")).alias("types"))
    profiles = profiles.select("profile", F.slice("types", 1, 2).alias("tools"))
    requests = table(spark, d, "events").select("event_id", F.col("user_id").alias("profile"), "event_type")
    return links.allowed(requests, "event_type", profiles, "profile").select("event_id", "event_type")


def ext_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return tumbling_counts(table(spark, d, "events").select("ts", "event_type"))


def ext_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.sum(cents).alias("sum_price_cents"), F.count(F.lit(1)).alias("n_lines"))


QUERIES: dict[str, Query] = {
    "seeded_sample": seeded_sample,
    "add_column_if_absent": add_column,
    "coverage_all_rows": coverage_all_rows,
    "hash_reconcile": hash_reconcile,
    "hash_identity_violations": hash_identity_violations,
    "inventory_by_status": inventory_by_status,
    "quantity_breaks": quantity_breaks,
    "selector_domain": selector_domain,
    "link_extraction": link_extraction,
    "follow_depth_1": follow_depth_1,
    "dangling_links": dangling_links,
    "no_silent_substitution": no_silent_substitution,
    "reconciled_lines": reconciled_lines,
    "tool_allow_list": tool_allow_list,
    "ext_event_windows": ext_event_windows,
    "ext_pricing_summary": ext_pricing_summary,
}


def _values(name: str, values: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{v}')" for v in values) + f") AS v_{name}({name})"


ORACLE: dict[str, str] = {
    "seeded_sample": f"""SELECT id, lang, n_chars, rank FROM (SELECT CAST(doc_id AS VARCHAR) AS id, lang, n_chars,
        row_number() OVER (ORDER BY sha256('{SEED}' || chr(10) || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS rank FROM documents)
        WHERE rank <= {SAMPLE}""",
    "add_column_if_absent": "SELECT doc_id, lang, CAST(NULL AS DATE) AS letter_date FROM documents",
    "coverage_all_rows": """SELECT lang, count(*) AS n_all, count(quality) AS n_ok, count(*) - count(quality) AS n_held
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
    "hash_reconcile": """SELECT coalesce(a.h, b.h) AS h, CASE WHEN b.n IS NULL THEN 'only_left' WHEN a.n IS NULL THEN 'only_right' ELSE 'both' END AS side,
        coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right
        FROM (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) a
        FULL JOIN (SELECT sha256(text) AS h, count(*) AS n FROM benchmark GROUP BY 1) b ON a.h IS NOT DISTINCT FROM b.h""",
    "hash_identity_violations": "SELECT sha256(text) AS h, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1",
    "inventory_by_status": """SELECT CASE WHEN quality IS NULL THEN 'held' WHEN quality = 1 THEN 'accepted' ELSE 'failed' END AS status,
        count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "quantity_breaks": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "selector_domain": f"SELECT family, form, topic FROM {_values('family', FAMILIES)}, {_values('form', FORMS)}, {_values('topic', TOPICS)}",
    "link_extraction": "SELECT 'n' || n_nationkey AS src, 'ref' AS field, CAST(n_regionkey AS VARCHAR) AS target, 'geo' AS package FROM nation",
    "follow_depth_1": """WITH RECURSIVE edges AS (SELECT 'n' || n_nationkey AS src, CAST(n_regionkey AS VARCHAR) AS target FROM nation),
        r AS (SELECT 'n' || n_nationkey AS node, 0 AS depth FROM nation
        UNION SELECT e.target, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 1)
        SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""",
    "dangling_links": "SELECT source, doc_id AS target FROM documents WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)",
    "no_silent_substitution": """SELECT doc_id, quality AS verified, CASE WHEN n_chars > 200 THEN 1 ELSE 0 END AS calculated,
        CASE WHEN quality IS NOT NULL THEN 'verified' ELSE 'calculated_only' END AS provenance FROM documents LEFT JOIN labels USING (doc_id)""",
    "reconciled_lines": "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars = length(text)",
    "tool_allow_list": """WITH p AS (SELECT user_id, list_sort(list(DISTINCT event_type))[1:2] AS tools FROM events GROUP BY 1)
        SELECT event_id, event_type FROM events JOIN p USING (user_id) WHERE list_contains(tools, event_type)""",
    "ext_event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY 1, 2",
    "ext_pricing_summary": """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_price_cents, count(*) AS n_lines
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
}
