"""Dedupe, article and stream queries, and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import articles as A
from ..operators import dedupe as D
from ..operators.frontier import bulk_change
from ..sources import tables as S
from ..sources.scratch import new_path
from ..sources import tables as S
from ..sources.scratch import new_path
from ..sources.seen import SeenSet
from ..streaming import streams as ST
from .hooks import Hooks, detail_mode
from .registry import NOW, query, stream, table
from .url_queries import BASE, DOMAIN, IDENTITY


@query(
    f"WITH k AS (SELECT page_id, {DOMAIN} AS domain, {IDENTITY} AS unid FROM pages), f AS (SELECT *, row_number() OVER (PARTITION BY unid ORDER BY page_id) AS n FROM k) SELECT domain, count(*) AS pages, count(*) FILTER (n = 1) AS new_articles FROM f GROUP BY domain"
)
def flagship_first_seen(spark, d):
    """Fetched pages to first-seen articles, counted by registered domain."""
    rows = table(spark, d, "pages").select(
        urls.domain(F.col("url")).alias("domain"), urls.article_id(F.col("url"), {"query": ["page"]}).alias("unid"),
        F.col("page_id").alias("ctime")
    )
    return D.insert_if_absent(rows, None).groupBy("domain").agg(F.count("*").alias("pages"), F.count_if("inserted").alias("new_articles"))


@query(f"""WITH b AS (SELECT page_id, md5({BASE}) AS unid FROM pages), s AS (SELECT unid, min(page_id) AS t FROM b WHERE page_id % 3 = 0 GROUP BY unid)
SELECT page_id, row_number() OVER (PARTITION BY unid ORDER BY page_id) = 1 AND t IS NULL AS inserted, coalesce(t, min(page_id) OVER (PARTITION BY unid)) AS seen_ctime FROM b LEFT JOIN s USING (unid) WHERE page_id % 3 <> 0""".replace("FROM b LEFT JOIN s USING (unid) WHERE page_id % 3 <> 0", "FROM (SELECT * FROM b WHERE page_id % 3 <> 0) LEFT JOIN s USING (unid)"))
def d1_insert_if_absent(spark, d):
    rows = table(spark, d, "pages").select(
        "page_id", F.md5(F.regexp_extract("url", "^([^?#]*)", 1)).alias("unid"), F.col("page_id").alias("ctime")
    )
    path = new_path(spark)
    seen = SeenSet(spark, f"seen_{path.rpartition('/')[2]}", path)
    seen.add(rows.where("page_id % 3 = 0").groupBy("unid").agg(F.min("ctime").alias("ctime")))
    return seen.mark(rows.where("page_id % 3 <> 0")).select("page_id", "inserted", "seen_ctime")


#: The bits of each key: h = h * (1 + seed) + code point over its characters, modulo 2^30, for the seeds 0 to 5.
KEY_BITS = """SELECT unid, old, list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(unid, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * (1 + seed) + c) % 1073741824) AS bit
FROM (SELECT url AS unid, bool_or(page_id % 2 = 0) AS old FROM pages WHERE url IS NOT NULL GROUP BY url), (SELECT unnest(range(0, 6)) AS seed)"""


@query(f"""WITH k AS ({KEY_BITS}), s AS (SELECT DISTINCT bit FROM k WHERE old)
SELECT unid, bool_or(s.bit IS NULL) AS is_new FROM k LEFT JOIN s USING (bit) GROUP BY unid""")
def d2_bloom_filter(spark, d):
    """Keys of the other pages are new unless all their bits are set, be it by different keys."""
    keys = table(spark, d, "pages").select("page_id", F.md5("url").alias("digest"), F.col("url").alias("unid"))
    bits = D.bloom_bits(keys.where("page_id % 2 = 0"))
    return D.bloom_check(keys, bits)


PAGES = "(SELECT l_orderkey AS run, l_linenumber AS page, min(l_suppkey) % 3 AS content, CASE WHEN min(l_quantity) < 15 THEN 0 ELSE min(l_quantity)::BIGINT END AS new_count, min(l_quantity)::BIGINT + 5 AS total FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def run_pages(spark, d):
    q = F.col("q").cast("long")
    lines = table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("page")
    ).agg(F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    return lines.select(
        "run", "page", (F.col("s") % 3).alias("content_md5"), F.when(F.col("q") < 15, 0).otherwise(q).cast("long").alias("new_count"),
        (q + 5).alias("total"), F.concat(F.lit("p"), F.col("page").cast("string")).alias("url")
    )


@query(
    f"WITH l AS (SELECT run, page, content = lag(content) OVER (PARTITION BY run ORDER BY page) AS same FROM {PAGES}) SELECT run, page FROM (SELECT *, max(coalesce(same, false)::INT) OVER (PARTITION BY run ORDER BY page) AS stop FROM l) WHERE stop = 0"
)
def d3_before_repeat(spark, d):
    return D.before_repeat(run_pages(spark, d).drop("url")).select("run", "page")


@query(
    f"SELECT run, page FROM (SELECT *, coalesce(sum((new_count = 0)::INT) OVER (PARTITION BY run ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS empty FROM {PAGES}) WHERE empty < 1"
)
def d4_until_nothing_new(spark, d):
    return D.until_nothing_new(run_pages(spark, d)).select("run", "page")


@query(
    f"SELECT page_id::VARCHAR AS acid, {DOMAIN} AS domain, least({NOW} + (page_id % 3 - 1) * 100, {NOW})::BIGINT AS pubtime, 0 AS status, length(html)::VARCHAR AS size FROM pages"
)
def a1_article_rows(spark, d):
    items = table(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("acid"), "url", F.lit("t").alias("title"),
        (NOW + (F.col("page_id") % 3 - 1) * 100).alias("pubtime"), F.length("html").alias("size")
    )
    return A.article_rows(items, NOW, ["size"]).select("acid", "domain", "pubtime", "status", F.col("result")["size"].alias("size"))


@query(f"""SELECT doc_id::VARCHAR AS rid, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END, ''), lang) AS title, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'q' || quality END AS author, CASE WHEN l.doc_id IS NULL THEN 0 WHEN toxic = 0 THEN {NOW} - 5 WHEN doc_id % 3 = 0 THEN {NOW} - 9 ELSE {NOW} END::BIGINT AS pubtime,
CASE WHEN l.doc_id IS NULL THEN 0 WHEN toxic = 0 OR doc_id % 3 = 0 THEN 2 ELSE 1 END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""".replace("WHEN l.doc_id IS NULL THEN 0 WHEN toxic = 0 THEN", "WHEN l.doc_id IS NULL THEN CASE WHEN doc_id % 3 = 0 THEN {0} - 9 ELSE 0 END WHEN toxic = 0 THEN".replace("{0}", str(NOW))).replace("coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END, ''), lang)", "CASE WHEN doc_id % 2 = 0 THEN source WHEN l.doc_id IS NULL THEN '' ELSE 'new' END"))
def a2_merge_detail(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    k = F.col("doc_id")
    old = docs.select(
        k.cast("string").alias("rid"), F.when(k % 2 == 0, F.col("source")).otherwise("").alias("title"), F.lit("old").alias("author"),
        F.lit("c").alias("channel"), F.when(k % 3 == 0, NOW - 9).otherwise(0).cast("long").alias("pubtime"),
        F.lit(None).cast("string").alias("content"), F.lit(0).alias("status"), F.lit(0).cast("long").alias("utime")
    )
    new = labels.select(
        k.cast("string").alias("rid"), F.lit("new").alias("title"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("author"),
        F.lit("").alias("channel"), F.when(F.col("toxic") == 0, NOW - 5).otherwise(0).cast("long").alias("pubtime"),
        F.lit("text").alias("content")
    )
    return A.merge_detail(old, new, NOW).select("rid", "title", "author", "pubtime", "status")


@query(
    "SELECT c_custkey::BIGINT AS acid, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'new' ELSE 'old' END AS title, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 2 WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 0 THEN 1 WHEN c_custkey % 15 = 0 THEN 1 ELSE 1 END::BIGINT AS ctime FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0 OR c_custkey % 5 = 0".replace(
        "CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 2 WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 0 THEN 1 WHEN c_custkey % 15 = 0 THEN 1 ELSE 1 END",
        "CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END"
    )
)
def a3_upsert(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.cast("long").alias("acid"), k)
    def rows(title: str, ctime: int, utime: int) -> list:
        times = [F.lit(v).cast("long").alias(name) for name, v in (("ctime", ctime), ("utime", utime))]
        return [F.col("acid").cast("string").alias("acid"), F.lit(title).alias("title"), *times]

    path = new_path(spark)
    S.write_table(S.conform(c.where("c_custkey % 2 = 0").select(*rows("old", 1, 1)), "articles"), path, "articles")
    incoming = c.where("c_custkey % 3 = 0 or c_custkey % 5 = 0").select(*rows("new", 3_000_000, 2))
    stale = c.where("c_custkey % 3 = 0").select(*rows("stale", 3_000_000, 1))
    S.upsert_months(spark, path, incoming.unionByName(stale))
    month = F.when(F.col("ym") == "197001", 1).otherwise(2).cast("long")
    return S.read_table(spark, path, "articles").select(F.col("acid").cast("long").alias("acid"), "title", month.alias("ctime"))


@query(
    "SELECT conv_id AS rid, md5(string_agg(text, chr(13) || chr(10) || chr(13) || chr(10) ORDER BY turn)) AS digest, first(role ORDER BY turn) AS role FROM conversations GROUP BY conv_id"
)
def a4_join_pages(spark, d):
    pages = table(spark, d, "conversations").select(
        F.col("conv_id").alias("rid"), F.col("turn").alias("page"), F.col("text").alias("content"), "role"
    )
    return A.join_pages(pages, others=["role"]).select("rid", F.md5("content").alias("digest"), "role")


@query(
    f"SELECT run, sum(total)::BIGINT AS total, sum(new_count)::BIGINT AS new_count, sum(total - new_count)::BIGINT AS repeat_count, count(*) AS page, sum((new_count = 0)::INT)::BIGINT AS repeat_page, count(*)::INT AS listed FROM {PAGES} GROUP BY run"
)
def a5_run_counters(spark, d):
    return A.run_counters(run_pages(spark, d), NOW).select(
        "run", "total", "new_count", "repeat_count", "page", "repeat_page", F.size("crawl_urls").alias("listed")
    )


@query("SELECT event_type AS class, count(*) AS n FROM events GROUP BY 1")
def a6_error_log(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("lid"), F.col("user_id").alias("tid"), F.lit("list").alias("mode"),
        F.lit("6").alias("frequency"), F.lit("u").alias("url"), F.col("event_type").alias("class"), F.col("props").alias("msg")
    )
    return A.error_counts(A.error_rows(e, NOW))


@query("SELECT ts::DATE AS day, count(*) AS articles FROM events GROUP BY 1")
def a7_daily_counts(spark, d):
    return A.daily_counts(table(spark, d, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ctime")))


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'result' ELSE 'item' END AS queue, '{"mode":"item","rid":"' || page_id || '"}' AS message FROM pages WHERE page_id % 3 <> 0"""
)
def a8_item_tasks(spark, d):
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(
        F.lit("item").alias("mode"), k.cast("string").alias("rid"),
        F.when(k % 3 == 0, "none").when(k % 3 == 1, "result").otherwise("item").alias("url_handle")
    )
    return A.item_tasks(rows).select(F.get_json_object("message", "$.rid").cast("long").alias("page_id"), "queue", "message")


# ---- streams: each runs over the files of a table as a stream, to its end ----------------------------------


def events(spark, d):
    return stream(spark, d, "events")


@query("""SELECT event_type AS mode, count(*) AS n, sum(event_id)::BIGINT AS seqs FROM events GROUP BY 1""")
def s5_message_stream(spark, d):
    """Messages written to the folders of their topics by one stream and read back by another."""
    folder = new_path(spark)
    value = F.to_json(F.struct(F.col("event_type").alias("mode"), F.col("user_id").alias("uid"), F.col("event_id").alias("seq")))
    out = events(spark, d).select(F.col("event_type").alias("topic"), value.alias("value"))
    ST.write_messages(out, f"{folder}/state", path=f"{folder}/topics", trigger={"availableNow": True}).awaitTermination()
    read = ST.run_available(ST.read_messages(spark, "json", f"{folder}/topics"))
    return read.groupBy("mode").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(
    "SELECT CASE WHEN event_id % 10 = 0 THEN 'list' WHEN event_type = 'click' THEN 'click' ELSE 'rejected' END AS handler, count(*) AS n FROM events GROUP BY 1"
)
def st1_dispatch(spark, d):
    m = events(spark, d).select(F.when(F.col("event_id") % 10 == 0, None).otherwise(F.col("event_type")).alias("mode"))
    out = None
    for name, df in ST.dispatch(m, ["list", "click"], default="list").items():
        part = df.select(F.lit(name).alias("handler"))
        out = part if out is None else out.unionByName(part)
    return ST.run_available(out).groupBy("handler").agg(F.count("*").alias("n"))


@query("SELECT user_id::VARCHAR AS unid, count(*) AS n FROM events GROUP BY ALL")
def st2_first_seen(spark, d):
    """Stateful first-seen keys, each joined back to how often it came."""
    keys = events(spark, d).select(F.col("user_id").cast("string").alias("unid"))
    first = ST.run_available(ST.first_seen(keys)).select("unid")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("unid")).join(first, "unid").groupBy("unid").agg(F.count("*").alias("n"))


@query(
    "SELECT uuid, array_to_string(list_sort(runs)[-10:], ',') AS runs FROM (SELECT o_custkey AS uuid, list(DISTINCT o_orderkey) AS runs FROM orders GROUP BY ALL)"
)
def st3_run_history(spark, d):
    """The last state of each task, from the updates of the stream."""
    runs = stream(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("uuid"), F.col("o_orderkey").cast("long").alias("run"))
    updates = ST.run_available(ST.run_history(runs), "update")
    return updates.groupBy("uuid").agg(F.max_by("runs", "epoch").alias("runs")).select(
        "uuid", F.array_join(F.col("runs").cast("array<string>"), ",").alias("runs")
    )


@query(
    "SELECT event_id, k AS attempt, CASE WHEN event_type = 'click' THEN 'ignore' WHEN event_type = 'view' AND k <= 5 THEN 'retry' ELSE 'log' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)"
)
def st4_retry(spark, d):
    errors = events(spark, d).select(
        F.col("user_id").alias("task"), F.col("event_type").alias("class"), F.col("event_id").alias("seq")
    )
    counted = ST.run_available(ST.with_attempts(errors))
    action = ST.retry_action(F.col("class"), F.col("attempt"), retried=("view",), ignored=("click",))
    return counted.select(F.col("seq").alias("event_id"), "attempt", action.alias("action"))


@query(f"""SELECT c_custkey AS tid, coalesce(last, '6') AS frequency, CASE WHEN last IS NULL THEN 0 ELSE {NOW} + CASE last WHEN '1' THEN 300 WHEN '2' THEN 600 WHEN '3' THEN 1800 WHEN '4' THEN 7200 WHEN '5' THEN 28800 ELSE 0 END END::BIGINT AS plantime
FROM customer LEFT JOIN (SELECT user_id, arg_max(event_id % 6, event_id)::VARCHAR AS last FROM events GROUP BY 1) ON c_custkey = user_id""")
def st5_apply_messages(spark, d):
    """Frequency messages of a stream, batch by batch on a stored table of tasks; each batch writes the next version."""
    folder = new_path(spark)
    start = table(spark, d, "customer").select(
        F.lit("m").alias("mode"), F.col("c_custkey").cast("long").alias("tid"), F.lit("6").alias("frequency"),
        F.lit(0).cast("long").alias("plantime"), F.lit(0).cast("long").alias("utime")
    )
    start.write.parquet(f"{folder}/start")
    versions = [f"{folder}/start"]

    def change(messages):
        old = spark.read.parquet(versions[-1])
        path = f"{folder}/{len(versions)}"
        bulk_change(old, messages, "frequency", NOW).write.mode("overwrite").parquet(path)
        versions.append(path)

    sent = F.to_json(
        F.struct(
            F.lit("m").alias("mode"), F.col("user_id").alias("tid"), (F.col("event_id") % 6).cast("string").alias("frequency"),
            F.col("event_id").alias("seq")
        )
    )
    messages = ST.parse_messages(events(spark, d).select(sent.alias("raw")))
    messages.writeStream.foreachBatch(ST.apply_messages(change)).option(
        "checkpointLocation", f"{folder}/state"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(versions[-1]).select("tid", "frequency", "plantime")


@query("SELECT event_id::VARCHAR AS rid, page_id IS NOT NULL AS found, url FROM events LEFT JOIN pages ON event_id = page_id")
def st6_detail_work(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("rid"), "url")
    good, bad = ST.detail_work(events(spark, d).select(F.lit("item").alias("mode"), F.col("event_id").cast("string").alias("rid")), pages)
    missing = bad.select("rid", F.lit(False).alias("found"), F.lit(None).cast("string").alias("url"))
    return ST.run_available(good.select("rid", F.lit(True).alias("found"), "url").unionByName(missing)).drop("epoch")


@query("SELECT ts::DATE AS day, count(*) AS articles FROM events GROUP BY 1")
def st7_daily_articles(spark, d):
    """Counts as last updated; a day's row comes again with every batch that changes it."""
    counts = ST.run_available(ST.daily_articles(events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts"), "update")
    return counts.groupBy("day").agg(F.max_by("articles", "epoch").alias("articles"))


@query("SELECT page_id, length(url) * 2 + 1 AS n FROM pages")
def e1_hooks(spark, d):
    hooks = Hooks()
    hooks.register("postparse", lambda df: df.withColumn("n", F.col("n") + 1), 1)
    hooks.register("postparse", lambda df: df.withColumn("n", F.col("n") * 2), 5)
    return hooks.run("postparse", table(spark, d, "pages").select("page_id", F.length("url").alias("n")))


@query("SELECT page_id, upper(regexp_extract(url, 'example\\.([a-z]+)', 1)) AS value FROM pages")
def e2_callbacks(spark, d):
    from ..operators.rules import post_process

    return table(spark, d, "pages").select(
        "page_id", post_process(F.col("url"), {"extract": "example.[r=t][a-z]+[/r]"}, F.upper).alias("value")
    )


@query(
    "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '.org') THEN 'org' ELSE 'item' END AS mode FROM pages"
)
def e3_detail_mode(spark, d):
    return table(spark, d, "pages").select(
        "page_id",
        detail_mode(
            F.col("url"), [lambda u: F.when(F.contains(u, F.lit("/en/")), "english"), lambda u: F.when(F.contains(u, F.lit(".org")), "org")]
        ).alias("mode")
    )
