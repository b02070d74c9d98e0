"""Table and frontier queries: orders play the spider tasks, customers the urls, nations the sites and rules, regions the projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frontier as P
from ..operators import query as Q
from ..sources import tables as S
from ..sources.scratch import new_path
from .registry import NOW, query, table

# the task table made from orders, as SQL for DuckDB
TASKS = f"""(SELECT o_orderkey AS uuid, 'm' || (o_orderkey % 2) AS mode, n_regionkey AS pid, c_nationkey AS sid, o_custkey % 50 AS tid, o_custkey AS uid, 0::BIGINT AS kid, c_nationkey AS rid,
CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 ELSE 2 END AS status, left(o_orderpriority, 1) AS frequency, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE {NOW} + (o_orderkey % 7 - 3) * 86400 END::BIGINT AS expire,
epoch(o_orderdate::DATE::TIMESTAMP)::BIGINT AS plantime, 0::BIGINT AS crawltime, 0::BIGINT AS utime, 'x' AS save FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
URLS = f"(SELECT c_custkey AS uuid, n_regionkey AS pid, c_nationkey AS sid, c_custkey % 50 AS tid, 'http://u.example.com/' || c_custkey AS url, CASE WHEN c_custkey % 5 = 0 THEN 'http://j.example.com/' || c_custkey END AS jsonUrl, CASE WHEN c_custkey % 11 = 0 THEN 0 WHEN c_custkey % 13 = 0 THEN 99 ELSE c_nationkey + 1 END AS ruleId, 1 AS ruleStatus, CASE WHEN c_custkey % 4 = 0 THEN 3600 ELSE 0 END::BIGINT AS expire, CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 1 END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey)"
RULES = "(SELECT n_nationkey + 1 AS uuid, (n_nationkey % 7)::VARCHAR AS frequency, CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE 1 END AS status FROM nation)"
WORDS = "(SELECT s_suppkey AS uuid, s_name AS word, CASE WHEN s_suppkey % 40 = 0 THEN NULL WHEN s_suppkey % 40 = 1 THEN 0 ELSE s_suppkey % 60 END AS tid, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 1 END AS status, CASE WHEN s_suppkey % 3 = 0 THEN '2' ELSE '' END AS frequency, CASE WHEN s_suppkey % 2 = 0 THEN 1800 ELSE 0 END::BIGINT AS expire FROM supplier)"
ACTIVE = f"(SELECT * FROM {TASKS} WHERE status = 1 AND (expire = 0 OR expire > {NOW}))"
SECONDS = "(CASE frequency WHEN '0' THEN 0 WHEN '1' THEN 300 WHEN '2' THEN 600 WHEN '3' THEN 1800 WHEN '4' THEN 7200 WHEN '5' THEN 28800 ELSE 86400 END)"


def tasks(spark, d) -> DataFrame:
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    status = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 0).otherwise(2)
    expire = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(NOW + (F.col("o_orderkey") % 7 - 3) * 86400).cast("long")
    return joined.select(
        F.col("o_orderkey").cast("long").alias("uuid"), F.concat(
            F.lit("m"), (F.col("o_orderkey") % 2).cast("string")
        ).alias("mode"), F.col("n_regionkey").cast("long").alias("pid"), F.col("c_nationkey").cast("long").alias("sid"),
        (F.col("o_custkey") % 50).cast("long").alias("tid"), F.col("o_custkey").cast("long").alias("uid"), F.lit(0).cast("long").alias("kid"), F.col("c_nationkey").cast("long").alias("rid"), status.alias("status"),
        F.substring("o_orderpriority", 1, 1).alias("frequency"), expire.alias("expire"), F.unix_timestamp(F.col("o_orderdate").cast("date").cast("timestamp")).alias("plantime"), F.lit(0).cast("long").alias("crawltime"), F.lit(0).cast("long").alias("utime"), F.lit("x").alias("save"),
    )


def urls(spark, d) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    k = F.col("c_custkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        k.cast("long").alias("uuid"), F.col("n_regionkey").cast("long").alias("pid"), F.col("c_nationkey").cast("long").alias("sid"), (k % 50).cast("long").alias("tid"), F.concat(
            F.lit("http://u.example.com/"), k.cast("string")
        ).alias("url"),
        F.when(
            k % 5 == 0, F.concat(F.lit("http://j.example.com/"), k.cast("string"))
        ).alias("jsonUrl"), F.when(k % 11 == 0, 0).when(k % 13 == 0, 99).otherwise(F.col("c_nationkey") + 1).cast("long").alias("ruleId"), F.lit(1).alias("ruleStatus"),
        F.when(k % 4 == 0, 3600).otherwise(0).cast("long").alias("expire"), F.when(k % 17 == 0, 0).otherwise(1).alias("status"),
    )


def rules(spark, d) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        (n + 1).cast("long").alias("uuid"), (n % 7).cast("string").alias("frequency"), F.when(n % 6 == 0, 0).otherwise(1).alias("status")
    )


def words(spark, d) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        s.cast("long").alias("uuid"), F.col("s_name").alias("word"),
        F.when(s % 40 == 0, None).when(s % 40 == 1, 0).otherwise(s % 60).cast("long").alias("tid"),
        F.when(s % 9 == 0, 0).otherwise(1).alias("status"), F.when(s % 3 == 0, "2").otherwise("").alias("frequency"),
        F.when(s % 2 == 0, 1800).otherwise(0).cast("long").alias("expire")
    )


def some_tasks(spark, d) -> DataFrame:
    """Existing tasks of the urls of even keys."""
    return tasks(spark, d).where("uid % 2 = 0")


# ---- sources -------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS uuid, o_orderpriority AS name FROM orders")
def s1_schema_table(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("uuid"), F.col("o_orderpriority").alias("name"))
    path = new_path(spark)
    S.write_table(S.conform(rows, "sites"), path, "sites")
    return S.read_table(spark, path, "sites").select("uuid", "name")


@query(
    "SELECT strftime(o_orderdate::DATE, '%Y%m') AS ym, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderdate::DATE >= DATE '1995-01-10' AND o_orderdate::DATE < DATE '1995-03-01' GROUP BY 1"
)
def s2_monthly_partition(spark, d):
    """Written by month; read back from the two months of the time range alone."""
    path = new_path(spark)
    articles = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("acid"),
        F.unix_timestamp(F.col("o_orderdate").cast("date").cast("timestamp")).alias("ctime")
    )
    S.write_table(S.conform(articles, "articles"), path, "articles")
    rows = S.read_months(spark, path, "articles", 789696000, 794016000)
    return rows.groupBy("ym").agg(F.count("*").alias("n"), F.sum(F.col("acid").cast("long")).alias("keys"))


@query(f"SELECT mode, count(*) AS n, sum(uuid)::BIGINT AS keys FROM {TASKS} WHERE mode = 'm1' GROUP BY mode")
def s3_mode_partition(spark, d):
    path = new_path(spark)
    S.write_table(S.conform(tasks(spark, d).drop("save"), "spider_task"), path, "spider_task")
    return S.read_modes(spark, path, "m1").groupBy("mode").agg(F.count("*").alias("n"), F.sum("uuid").alias("keys"))


@query(
    "SELECT left(md5(url), 1) AS digit, count(DISTINCT md5(url)) AS n FROM pages WHERE page_id % 3 = 0 AND url IN (SELECT url FROM pages WHERE page_id % 2 = 0) GROUP BY 1"
)
def s4_seen_buckets(spark, d):
    """The seen set by first digit, asked for the keys of a batch."""
    path = new_path(spark)
    keys = table(spark, d, "pages").select("page_id", F.md5("url").alias("unid"))
    S.write_table(keys.where("page_id % 2 = 0").groupBy("unid").agg(F.min("page_id").alias("ctime")), path, "unique")
    known = S.seen_of(spark, path, keys.where("page_id % 3 = 0"))
    return known.groupBy(F.substring("unid", 1, 1).alias("digit")).agg(F.count("*").alias("n"))


@query(
    """SELECT q AS topic, '{"mode":"list","rid":"' || page_id || '"}' AS value FROM pages, (VALUES ('search'), ('archive'), ('export')) t(q)"""
)
def s6_fan_out(spark, d):
    return S.fan_out(
        table(spark, d, "pages").select(F.lit("list").alias("mode"), F.col("page_id").cast("string").alias("rid")),
        ["search", "archive", "export"]
    )


# ---- query and update ------------------------------------------------------------------------------------------


@query(
    f"SELECT uuid FROM {TASKS} WHERE status <> 0 AND (frequency IN ('1', '3') OR uid > 100) AND NOT (sid IN (1, 2, 3)) AND regexp_matches(frequency, '[1-4]')"
)
def q1_where(spark, d):
    spec = [
        ("status", "<>", 0), {"or": [("frequency", "IN", ["1", "3"]), ("uid", ">", 100)], "and": [("sid", "NOT IN", [1, 2, 3])]},
        ("frequency", "regex", "[1-4]")
    ]
    return tasks(spark, d).where(Q.where(spec)).select("uuid")


@query(f"SELECT uuid, plantime FROM {TASKS} WHERE status = 1 ORDER BY plantime DESC, uuid LIMIT 10 OFFSET 5")
def q2_find(spark, d):
    return Q.find(tasks(spark, d), {"status": 1}, ["uuid", "plantime"], [("plantime", -1), ("uuid", 1)], offset=5)


@query(f"SELECT uuid, frequency FROM {TASKS} WHERE uid = 7 ORDER BY uuid LIMIT 1")
def q3_get(spark, d):
    return Q.get(tasks(spark, d), {"uid": 7}, ["uuid", "frequency"], [("uuid", 1)])


@query(f"SELECT count(*) AS n FROM {TASKS} WHERE frequency IN ('1', '2')")
def q4_count(spark, d):
    return Q.count(tasks(spark, d), {"frequency": ["1", "2"]})


@query(
    f"WITH t AS (SELECT * FROM {TASKS}) SELECT uuid, CASE WHEN sid = 3 THEN 5 ELSE CASE WHEN uuid = (SELECT min(uuid) FROM t WHERE sid = 4) THEN 6 ELSE status END END AS status, CASE WHEN sid = 3 OR uuid = (SELECT min(uuid) FROM t WHERE sid = 4) THEN {NOW} ELSE 0 END::BIGINT AS utime FROM t"
)
def q5_update(spark, d):
    many = Q.update(tasks(spark, d), {"status": 5}, {"sid": 3}, now=NOW)
    return Q.update(many, {"status": 6}, {"sid": 4}, now=NOW, multi=False).select(
        "uuid", "status", F.col("utime").cast("long").alias("utime")
    )


@query(f"SELECT uuid, CASE WHEN frequency = '5' THEN -1 ELSE status END AS status FROM {TASKS} WHERE frequency <> '2'")
def q6_delete(spark, d):
    return Q.hard_delete(Q.soft_delete(tasks(spark, d), {"frequency": "5"}, now=NOW), {"frequency": "2"}).select("uuid", "status")


@query(f"SELECT uuid FROM {URLS} WHERE uuid > 100 AND pid = 2 ORDER BY uuid LIMIT 25")
def q7_keyset_page(spark, d):
    return Q.page_after(urls(spark, d), 100, 25, {"pid": 2}).select("uuid")


@query(f"SELECT max(uuid) AS max_id FROM {TASKS} WHERE mode = 'm0'")
def q8_max_id(spark, d):
    return Q.max_id(tasks(spark, d), spec={"mode": "m0"})


@query(
    "SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderkey) AS uuid, base64(encode(strftime(o_orderdate::DATE, '%Y%m') || o_orderkey)) AS rid, strftime(o_orderdate::DATE, '%Y%m') AS ym FROM orders"
)
def q9_assign_ids(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("date").cast("timestamp")).alias("t"))
    rid = Q.build_month_id(F.col("t"), F.col("o_orderkey"))
    return Q.assign_ids(rows, ["o_orderkey"], start=1000).select(
        "o_orderkey", "uuid", rid.alias("rid"), Q.split_month_id(rid)["ym"].alias("ym")
    )


@query(f"SELECT c_custkey AS uuid, 0 AS status, {NOW}::BIGINT AS ctime, 0::BIGINT AS plantime, 0::BIGINT AS expire FROM customer")
def q10_defaults(spark, d):
    return Q.with_defaults(
        table(spark, d, "customer").select(F.col("c_custkey").alias("uuid"), F.lit(None).cast("int").alias("status")), now=NOW
    ).select("uuid", "status", F.col("ctime").cast("long").alias("ctime"), "plantime", "expire")


# ---- frontier ---------------------------------------------------------------------------------------------------


@query(f"SELECT mode, frequency, count(*) AS total FROM {ACTIVE} GROUP BY ALL")
def p1_active(spark, d):
    return P.active_counts(tasks(spark, d), NOW)


@query(f"SELECT uuid, plantime FROM {ACTIVE} WHERE plantime <= {NOW} AND uuid > 500")
def p2_due(spark, d):
    return P.due(tasks(spark, d), NOW, 500).select("uuid", "plantime")


SLICES = f"""(WITH c AS (SELECT mode, frequency, count(*) AS total FROM {ACTIVE} GROUP BY ALL), q AS (SELECT *, ceil(total / greatest({SECONDS} / 60.0, 1.0))::BIGINT AS quota FROM c)
SELECT mode, frequency, unnest(range(0, least(quota, total), 100)) AS "offset", quota FROM q)"""


@query(f"SELECT mode, frequency, \"offset\", least(100, quota - \"offset\") AS count FROM {SLICES} t")
def p3_route(spark, d):
    return P.route_batches(P.active_counts(tasks(spark, d), NOW), None, NOW)[0]


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY mode, frequency ORDER BY uuid) - 1 AS pos FROM {ACTIVE}), s AS (SELECT mode, frequency, max(quota) AS quota FROM {SLICES} t GROUP BY ALL)
SELECT uuid, {NOW} + {SECONDS} AS plantime FROM r JOIN s USING (mode, frequency) WHERE pos < quota""")
def p4_batch_slice(spark, d):
    t = tasks(spark, d)
    return P.batch_slices(t, P.route_batches(P.active_counts(t, NOW), None, NOW)[0], NOW).select("uuid", "plantime")


@query(
    f"SELECT uuid, {NOW} + {SECONDS} AS plantime FROM {ACTIVE} WHERE plantime <= {NOW} AND uuid > 0 AND (mode = 'm0' AND sid = 3 OR mode = 'm1' AND uid IN (5, 6))"
)
def p5_schedule(spark, d):
    n = table(spark, d, "nation").where("n_nationkey = 3").select(
        F.lit("m0").alias("mode"), F.lit("site").alias("type"), F.col("n_nationkey").cast("long").alias("item")
    )
    c = table(spark, d, "customer").where("c_custkey in (5, 6)").select(
        F.lit("m1").alias("mode"), F.lit("url").alias("type"), F.col("c_custkey").cast("long").alias("item")
    )
    return P.schedule_by(tasks(spark, d), n.unionByName(c), NOW).select("uuid", "plantime")


def _change(spark, d, **fields) -> DataFrame:
    """Messages of two nations (sites), one after the other, for both modes."""
    n = table(spark, d, "nation").where("n_nationkey in (3, 4)")
    modes = n.select(
        F.explode(F.array(F.lit("m0"), F.lit("m1"))).alias("mode"), F.lit(None).cast("long").alias("pid"),
        F.col("n_nationkey").cast("long").alias("sid"), F.col("n_nationkey").cast("long").alias("seq")
    )
    return modes.withColumns({k: F.lit(v) for k, v in fields.items()})


@query(
    f"SELECT uuid, CASE WHEN sid IN (3, 4) THEN '2' ELSE frequency END AS frequency, CASE WHEN sid IN (3, 4) THEN {NOW} + 600 ELSE plantime END AS plantime FROM {TASKS}"
)
def p6_frequency(spark, d):
    return P.bulk_change(tasks(spark, d), _change(spark, d, frequency="2"), "frequency", NOW).select("uuid", "frequency", "plantime")


@query(f"SELECT uuid, CASE WHEN sid IN (3, 4) THEN {NOW} + 7200 ELSE expire END AS expire FROM {TASKS}")
def p7_expire(spark, d):
    return P.bulk_change(tasks(spark, d), _change(spark, d, expire=7200), "expire", NOW).select("uuid", "expire")


@query(
    f"SELECT uuid, CASE WHEN uuid % 2 = 0 THEN 'pid' WHEN uuid % 3 = 0 THEN 'rid' WHEN uuid % 5 = 0 THEN 'uid' END AS key_name, CASE WHEN uuid % 2 = 0 THEN pid WHEN uuid % 3 = 0 THEN rid WHEN uuid % 5 = 0 THEN uid END AS key_value FROM {TASKS}"
)
def p8_message_key(spark, d):
    u = F.col("uuid")
    m = tasks(spark, d).select(
        "uuid", F.when(u % 2 == 0, F.col("pid")).alias("pid"), F.when(u % 3 == 0, F.col("rid")).alias("rid"),
        F.when(u % 5 == 0, F.col("uid")).alias("uid")
    )
    return P.message_key(m).select("uuid", "key_name", "key_value")


@query(f"""SELECT 'sites' AS name, n_nationkey::BIGINT AS uuid, CASE WHEN n_regionkey = 1 THEN 0 ELSE 1 END AS status FROM nation UNION ALL
SELECT 'urls', uuid, CASE WHEN tid = 8 THEN -1 WHEN pid = 1 THEN 0 ELSE status END FROM {URLS} UNION ALL
SELECT 'spider_tasks', uuid, CASE WHEN uid = 7 THEN 1 WHEN tid = 8 THEN -1 WHEN pid = 1 THEN 0 ELSE status END FROM {TASKS}""")
def p9_status_cascade(spark, d):
    r = table(spark, d, "region").where("r_regionkey = 1").select(
        F.lit(None).cast("string").alias("mode"), F.lit(2).alias("status"), F.col("r_regionkey").cast("long").alias("pid"),
        F.lit(None).cast("long").alias("sid"), F.lit(None).cast("long").alias("tid"), F.lit(None).cast("long").alias("uid"),
        F.lit(None).cast("long").alias("kid"), F.lit(1).cast("long").alias("seq")
    )
    c = table(spark, d, "customer").where("c_custkey in (7, 8)").select(
        F.lit(None).cast("string").alias("mode"), F.when(F.col("c_custkey") == 8, -1).otherwise(1).alias("status"),
        F.lit(None).cast("long").alias("pid"), F.lit(None).cast("long").alias("sid"),
        F.when(F.col("c_custkey") == 8, 8).cast("long").alias("tid"), F.when(F.col("c_custkey") == 7, 7).cast("long").alias("uid"),
        F.lit(None).cast("long").alias("kid"), (10 - F.col("c_custkey")).cast("long").alias("seq")
    )
    sites = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("uuid"), F.col("n_regionkey").cast("long").alias("pid"), F.lit(1).alias("status"),
        F.lit(0).cast("long").alias("utime")
    )
    done = P.status_cascade({"sites": sites, "urls": urls(spark, d), "spider_tasks": tasks(spark, d)}, r.unionByName(c), NOW)
    out = None
    for name, df in done.items():
        part = df.select(F.lit(name).alias("name"), "uuid", "status")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"SELECT u.uuid AS uid, coalesce(r.frequency, '6') AS frequency, CASE WHEN expire > 0 THEN {NOW} + expire ELSE 0 END AS expire FROM {URLS} u LEFT JOIN {RULES} r ON ruleId = r.uuid WHERE u.uuid NOT IN (SELECT uid FROM {TASKS} WHERE uid % 2 = 0 AND mode = 'm0')"
)
def p10_new_list_tasks(spark, d):
    return P.new_list_tasks(urls(spark, d), some_tasks(spark, d), rules(spark, d), "m0", NOW).select("uid", "frequency", "expire")


RECONCILED = "least(coalesce(r.frequency::INT, 6), nullif(w.frequency, '')::INT)::VARCHAR AS frequency, CASE WHEN coalesce(least(nullif(u.expire, 0), nullif(w.expire, 0)), 0) > 0 THEN {NOW} + least(nullif(u.expire, 0), nullif(w.expire, 0)) ELSE 0 END AS expire".replace("{NOW}", str(NOW))


@query(
    f"SELECT u.uuid AS uid, w.uuid AS kid, {RECONCILED} FROM {URLS} u JOIN {WORDS} w ON coalesce(w.tid, 0) = 0 OR w.tid = u.tid LEFT JOIN {RULES} r ON ruleId = r.uuid WHERE u.uuid NOT IN (SELECT uid FROM {TASKS} WHERE uid % 2 = 0 AND mode = 'm0')"
)
def p11_search_tasks_by_url(spark, d):
    return P.new_search_tasks_by_url(
        urls(spark, d), words(spark, d), some_tasks(spark, d), rules(spark, d), "m0", NOW
    ).select("uid", "kid", "frequency", "expire")


@query(
    f"SELECT u.uuid AS uid, w.uuid AS kid, {RECONCILED} FROM {URLS} u JOIN {WORDS} w ON coalesce(w.tid, 0) = 0 OR w.tid = u.tid LEFT JOIN {RULES} r ON ruleId = r.uuid WHERE u.tid < 20 AND (u.uuid % 2 = 1 OR w.uuid NOT BETWEEN 1 AND 20 OR u.uuid NOT IN (SELECT uid FROM {TASKS} WHERE mode = 'm0'))"
)
def p12_search_tasks_by_keyword(spark, d):
    kinds = urls(spark, d).where("tid < 20").select("tid").distinct()
    have = some_tasks(spark, d).drop("kid").withColumn(
        "kid", F.explode(F.sequence(F.lit(1), F.lit(20)))
    ).withColumn("kid", F.col("kid").cast("long"))
    return P.new_search_tasks_by_keyword(
        words(spark, d), kinds, urls(spark, d), have, rules(spark, d), "m0", NOW
    ).select("uid", "kid", "frequency", "expire")


@query(
    f"SELECT w.uuid AS kid, u.uuid AS uid, {RECONCILED} FROM {URLS} u JOIN {WORDS} w ON w.tid = u.tid AND w.tid <> 0 LEFT JOIN {RULES} r ON ruleId = r.uuid"
)
def p13_reconcile(spark, d):
    return P.reconciled_tasks(urls(spark, d), words(spark, d), rules(spark, d), "m0", NOW).select("kid", "uid", "frequency", "expire")


JUDGE = "CASE WHEN u.uuid IS NULL THEN 'delete' WHEN u.status <> 1 OR u.ruleStatus <> 1 THEN 'disable' WHEN coalesce(u.ruleId, 0) = 0 THEN 'error' WHEN r.uuid IS NULL THEN 'delete' WHEN r.status <> 1 THEN 'error' ELSE 'ok' END"


@query(
    f"SELECT t.uuid, {JUDGE} AS action, coalesce(u.jsonUrl, u.url) AS fetch_url FROM {TASKS} t LEFT JOIN (SELECT * FROM {URLS} WHERE uuid % 19 <> 0) u ON t.uid = u.uuid LEFT JOIN {RULES} r ON u.ruleId = r.uuid"
)
def p14_match_list_rule(spark, d):
    return P.match_list_rule(tasks(spark, d), urls(spark, d).where("uuid % 19 <> 0"), rules(spark, d)).select("uuid", "action", "fetch_url")


@query(
    f"SELECT t.uuid, CASE WHEN w.uuid IS NULL THEN 'delete' WHEN w.status <> 1 THEN 'disable' ELSE {JUDGE} END AS action, w.word FROM (SELECT * REPLACE (uuid % 120 AS kid) FROM {TASKS}) t LEFT JOIN {WORDS} w ON t.kid = w.uuid LEFT JOIN {URLS} u ON t.uid = u.uuid LEFT JOIN {RULES} r ON u.ruleId = r.uuid"
)
def p15_match_search_rule(spark, d):
    t = tasks(spark, d).withColumn("kid", F.col("uuid") % 120)
    return P.match_search_rule(t, words(spark, d), urls(spark, d), rules(spark, d)).select("uuid", "action", "word")


@query(f"SELECT s_suppkey, 'http://s.com/?a={NOW - 86400}&b={NOW - 36000}&q=' || replace(s_name, '#', '%23') AS url FROM supplier")
def p16_search_request(spark, d):
    return table(spark, d, "supplier").select(
        "s_suppkey", P.search_url(F.lit("http://s.com/?a={yesterday}&b={lasthour}&q={q}"), F.col("s_name"), NOW, "q").alias("url")
    )


@query(
    f"SELECT uuid, p AS page, CASE WHEN p = 1 THEN url ELSE url || '?pn=' || (p - 1) * 10 END AS page_url FROM {URLS}, (SELECT unnest(range(1, 4)) AS p)"
)
def p17_page_requests(spark, d):
    return P.page_requests(
        urls(spark, d), "url", {"key": "pn", "value": 0, "step": 10, "max": 3}
    ).select("uuid", F.col("page").cast("long").alias("page"), "page_url")


@query(
    f"SELECT uuid, url || '?k=v+' || uuid AS by_get, url || '/x' || uuid AS by_path, replace(url, 'u.example', 'y' || uuid) AS by_regex FROM {URLS}"
)
def p18_put_slots(spark, d):
    u, k = F.col("url"), F.col("uuid").cast("string")
    return urls(spark, d).select(
        "uuid", P.put_slot(u, "k", F.concat(F.lit("v "), k)).alias("by_get"),
        P.put_slot(u, "", F.concat(F.lit("x"), k), "path").alias("by_path"),
        P.put_slot(u, r"u\.example", F.concat(F.lit("y"), k), "replace").alias("by_regex")
    )


@query(f"""WITH r AS (SELECT o_custkey AS uuid, o_orderkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders)
SELECT c_custkey::BIGINT AS uuid, string_agg(run::VARCHAR, ',' ORDER BY run) AS runs, CASE WHEN count(run) > 0 THEN {NOW} ELSE 0 END::BIGINT AS crawltime, CASE WHEN count(run) > 0 AND c_custkey % 7 = 0 THEN 0 ELSE 1 END AS status FROM customer LEFT JOIN r ON c_custkey = uuid AND k <= 10 GROUP BY c_custkey""")
def p19_close_runs(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("uuid"), F.col("o_orderkey").alias("run"))
    t = table(spark, d, "customer").select(
        F.col("c_custkey").cast("long").alias("uuid"), F.when(F.col("c_custkey") % 7 == 0, "0").otherwise("6").alias("frequency"),
        F.lit(0).cast("long").alias("crawltime"), F.lit(1).alias("status")
    )
    return P.close_runs(runs, t, NOW).select("uuid", F.array_join("runs", ",").alias("runs"), "crawltime", "status")


@query(
    "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'update' WHEN page_id % 3 = 0 THEN 'bbs-item' ELSE 'item' END AS what FROM pages WHERE page_id % 4 <> 0"
)
def p20_rebuild_items(spark, d):
    k = F.col("page_id")
    a = table(spark, d, "pages").select(
        k.alias("acid"), k.alias("rid"), F.when(k % 5 == 0, "javascript:x()").otherwise(F.col("url")).alias("url"),
        F.when(k % 4 == 0, 1).otherwise(0).alias("status"), F.when(k % 3 == 0, 3).otherwise(1).alias("mediaType")
    )
    updates, messages = P.rebuild_items(a, {3: "bbs-item"})
    return updates.select(F.col("rid").alias("page_id"), F.lit("update").alias("what")).unionByName(
        messages.select(F.col("rid").alias("page_id"), F.col("mode").alias("what"))
    )
