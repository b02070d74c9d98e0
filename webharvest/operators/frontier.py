"""Frontier planning: due tasks, route batches, new tasks, status cascades, rule resolution, search requests, run history."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import build_query, filter_query, quote_plus
from .query import where
from .ranges import ROWS, numbered

# Seconds of each frequency code.
FREQUENCIES = {"0": 0, "1": 300, "2": 600, "3": 1800, "4": 7200, "5": 28800, "6": 86400}
DEFAULT_FREQUENCY = "6"
SLICE = 100
RUNS_KEPT = 10
#: Deals of the rows in a product, at least, and the rows of one deal.
SPREAD, DEAL_ROWS = 32, 50_000


def frequency_seconds(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FREQUENCIES.items() for x in pair])
    return F.try_element_at(table, F.coalesce(code.cast("string"), F.lit(DEFAULT_FREQUENCY))).cast("long")


def active(tasks: DataFrame, now: int, spec=None) -> DataFrame:
    """Status 1 and not expired."""
    return tasks.where((F.col("status") == 1) & ((F.col("expire") == 0) | (F.col("expire") > now)) & where(spec))


def active_counts(tasks: DataFrame, now: int) -> DataFrame:
    return active(tasks, now).groupBy("mode", "frequency").agg(F.count("*").alias("total"))


def due(tasks: DataFrame, now: int, last: int = 0, spec=None) -> DataFrame:
    """Active tasks whose plantime has come, with uuid over `last`; sort by uuid where order matters."""
    return active(tasks, now, spec).where((F.col("plantime") <= now) & (F.col("uuid") > last))


def route_batches(counts: DataFrame, state: DataFrame | None, now: int, interval: int = 60) -> tuple[DataFrame, DataFrame]:
    """(slices, next state) per (mode, frequency).

    counts: (mode, frequency, total); state: (mode, frequency, offset, ltime, stime, total).  Slices are (mode,
    frequency, offset, count) of at most SLICE rows, until the quota is spent or the offset passes the total.
    """
    base = counts.withColumn("seconds", frequency_seconds(F.col("frequency")))
    if state is None:
        joined = base.withColumns({c: F.lit(None).cast("long") for c in ("old_offset", "ltime", "stime", "old_total")})
    else:
        old = state.select("mode", "frequency", F.col("offset").alias("old_offset"), "ltime", "stime", F.col("total").alias("old_total"))
        joined = base.join(old, ["mode", "frequency"], "left")
    # a one-off frequency is paced at two a second of the interval; a finished cycle starts over and is counted anew
    fresh = F.col("stime").isNull() | (
        F.col("stime") + F.when(
            F.col("seconds") == 0, interval * F.ceil(F.coalesce("old_total", "total") / (2 * interval))
        ).otherwise(F.col("seconds")) <= now
    )
    rows = joined.withColumn("fresh", fresh).withColumn("all", F.when(F.col("fresh"), F.col("total")).otherwise(F.col("old_total")))
    rows = rows.withColumn("offset", F.when(F.col("fresh"), 0).otherwise(F.col("old_offset")).cast("long"))
    rows = rows.withColumn(
        "cycle", F.when(F.col("seconds") == 0, interval * F.ceil(F.col("all") / (2 * interval))).otherwise(F.col("seconds"))
    )
    average = F.ceil(F.col("all") / F.greatest(F.col("cycle") / interval, F.lit(1.0)))
    quota = F.when(F.col("ltime").isNull() | F.col("fresh"), average).otherwise(average * F.bround((now - F.col("ltime")) / interval, 0))
    rows = rows.withColumn("count", quota.cast("long"))
    room = F.least(F.col("count"), F.col("all") - F.col("offset"))
    starts = F.when(
        room > 0, F.sequence(F.lit(0).cast("long"), room - 1, F.lit(SLICE).cast("long"))
    ).otherwise(F.array().cast("array<bigint>"))
    slices = rows.select("mode", "frequency", "offset", "count", F.explode(starts).alias("at")).select(
        "mode", "frequency", (F.col("offset") + F.col("at")).alias("offset"),
        F.least(F.lit(SLICE), F.col("count") - F.col("at")).cast("long").alias("count")
    )
    following = rows.select(
        "mode", "frequency", (F.col("offset") + F.col("count")).alias("offset"), F.lit(now).cast("long").alias("ltime"),
        F.when(F.col("fresh"), F.lit(now)).otherwise(F.col("stime")).cast("long").alias("stime"), F.col("all").alias("total")
    )
    return slices, following


def batch_slices(tasks: DataFrame, slices: DataFrame, now: int, rows: int = ROWS) -> DataFrame:
    """Tasks of the given slices, in uuid order inside (mode, frequency), with their new plantime.

    The few groups are large, so rows are numbered in ranges of (mode, frequency, uuid), about `rows` to a range, whose
    counts give offsets; slices join on an equality of (mode, frequency, slice number).
    """
    keys = ["mode", "frequency"]
    live = numbered(active(tasks, now), [*keys, "uuid"], rows, "_place")
    begins = live.groupBy(*keys).agg(F.min("_place").alias("_begin"))  # a row for each group
    places = live.join(F.broadcast(begins), keys).withColumn("_at", F.col("_place") - F.col("_begin"))
    first = slices.groupBy(*keys).agg(F.min("offset").alias("_first"))
    number = F.floor((F.col("offset") - F.col("_first")) / SLICE)
    cut = slices.join(first, keys).select(*keys, number.alias("_slice"), F.col("offset").alias("_offset"), F.col("count").alias("_count"))
    placed = places.join(F.broadcast(first), keys).withColumn("_slice", F.floor((F.col("_at") - F.col("_first")) / SLICE))
    inside = (F.col("_at") >= F.col("_offset")) & (F.col("_at") < F.col("_offset") + F.col("_count"))
    chosen = placed.join(cut, [*keys, "_slice"]).where(inside)
    return chosen.withColumn("plantime", now + frequency_seconds(F.col("frequency"))).select(*tasks.columns)


def schedule_by(tasks: DataFrame, messages: DataFrame, now: int) -> DataFrame:
    """Due tasks named by messages (mode, type, item), type one of project, site, url, task; with their new plantime."""
    column = {"project": "pid", "site": "sid", "url": "uid", "task": "tid"}
    out = None
    for kind, key in column.items():
        items = messages.where(F.col("type") == kind).select("mode", F.col("item").alias(key)).distinct()
        hit = due(tasks, now).join(items, ["mode", key], "left_semi").select(*tasks.columns)
        out = hit if out is None else out.unionByName(hit)
    return out.dropDuplicates(["uuid"]).withColumn("plantime", now + frequency_seconds(F.col("frequency")))


def message_key(df: DataFrame) -> DataFrame:
    """With (key_name, key_value) of a message: the first of pid, sid, rid, tid, kid, uid that is set; NULLs if none."""
    keys = [k for k in ("pid", "sid", "rid", "tid", "kid", "uid") if k in df.columns]
    name, value = F.lit(None).cast("string"), F.lit(None).cast("long")
    for k in reversed(keys):
        name, value = F.when(F.col(k).isNotNull(), F.lit(k)).otherwise(name), F.when(
            F.col(k).isNotNull(), F.col(k).cast("long")
        ).otherwise(value)
    return df.withColumns({"key_name": name, "key_value": value})


def _latest(messages: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last message for each mode and key value."""
    hit = message_key(messages).where(F.col("key_name") == key)
    return hit.groupBy("mode", F.col("key_value").alias(key)).agg(F.max_by(value, order).alias(f"_{key}"), F.max(order).alias(f"_{key}_at"))


def bulk_change(tasks: DataFrame, messages: DataFrame, field: str, now: int, order: str = "seq") -> DataFrame:
    """Apply messages (mode, field, one key, seq) to tasks; the latest message that names a task wins.

    field `frequency` also sets plantime to now + frequency; field `expire` is relative to now, 0 stays never.
    """
    out = tasks
    stamps, values = [], []
    for key in ("pid", "sid", "rid", "tid", "kid", "uid"):
        if key in tasks.columns and key in messages.columns:
            out = out.join(_latest(messages, key, field, order), ["mode", key], "left")
            stamps.append(F.col(f"_{key}_at"))
            values.append(F.struct(F.col(f"_{key}_at").alias("at"), F.col(f"_{key}").alias("v")))
    best = F.array_max(F.array(*values))["v"]
    hit = F.coalesce(*stamps).isNotNull()
    if field == "frequency":
        changes = {
            "frequency": F.when(hit, best).otherwise(F.col("frequency")),
            "plantime": F.when(hit, now + frequency_seconds(best)).otherwise(F.col("plantime"))
        }
    else:
        changes = {"expire": F.when(hit, F.when(best > 0, now + best).otherwise(0)).otherwise(F.col("expire")).cast("long")}
    return out.withColumns({**changes, "utime": F.when(hit, F.lit(now)).otherwise(F.col("utime")).cast("long")}).select(*tasks.columns)


#: Tables that a status message by each key reaches.
_REACH = {
    "pid": ("sites", "tasks", "urls", "spider_tasks"), "sid": ("tasks", "urls", "spider_tasks"), "tid": ("urls", "spider_tasks"),
    "uid": ("spider_tasks",), "kid": ("spider_tasks",)
}


def status_cascade(tables: Mapping[str, DataFrame], messages: DataFrame, now: int, order: str = "seq") -> dict[str, DataFrame]:
    """Apply status messages (mode or NULL for all, status, one of pid, sid, tid, uid, kid, seq) to the four tables.

    Status 2 disables (writes 0), -1 deletes, 1 activates spider tasks by uid or kid only (uid also plans them
    now); other messages do nothing.  Disabling or deleting by uid or kid clears `save`.
    """
    keyed = message_key(messages).where(F.col("status").isin(2, -1) | ((F.col("status") == 1) & F.col("key_name").isin("uid", "kid")))
    own = {
        "sites": {"pid": "pid"}, "tasks": {"pid": "pid", "sid": "sid"}, "urls": {"pid": "pid", "sid": "sid", "tid": "tid"},
        "spider_tasks": {k: k for k in _REACH}
    }
    out = {}
    for name, df in tables.items():
        result, found = df, []
        for key, column in own[name].items():
            if name not in _REACH[key] or column not in df.columns:
                continue
            hit = keyed.where(F.col("key_name") == key)
            if name != "spider_tasks":
                latest = hit.groupBy(F.col("key_value").alias(column)).agg(F.max(F.struct(order, "status")).alias(f"_{key}"))
                result = result.join(latest, column, "left")
            else:
                for scope, cond in (("all", F.col("mode").isNull()), ("one", F.col("mode").isNotNull())):
                    part = hit.where(cond)
                    by = [F.col("key_value").alias(column)] + ([F.col("mode")] if scope == "one" else [])
                    latest = part.groupBy(*by).agg(F.max(F.struct(order, "status")).alias(f"_{key}_{scope}"))
                    result = result.join(latest, [column] + (["mode"] if scope == "one" else []), "left")
                result = result.withColumn(f"_{key}", F.array_max(F.array(f"_{key}_all", f"_{key}_one")))
            found.append(F.struct(F.col(f"_{key}.{order}").alias("at"), F.col(f"_{key}.status").alias("status"), F.lit(key).alias("key")))
        last = F.array_max(F.filter(F.array(*found), lambda x: x["at"].isNotNull()))
        hit = last.isNotNull()
        status = F.when(last["status"] == 2, 0).otherwise(last["status"])
        changes = {"status": F.when(hit, status).otherwise(F.col("status")).cast(df.schema["status"].dataType)}
        if "utime" in df.columns:
            changes["utime"] = F.when(hit, F.lit(now)).otherwise(F.col("utime")).cast("long")
        if name == "spider_tasks":
            if "plantime" in df.columns:
                changes["plantime"] = F.when(
                    hit & (last["status"] == 1) & (last["key"] == "uid"), F.lit(now)
                ).otherwise(F.col("plantime")).cast("long")
            if "save" in df.columns:
                changes["save"] = F.when(hit & last["key"].isin("uid", "kid") & (last["status"] != 1), F.lit(None)).otherwise(F.col("save"))
        out[name] = result.withColumns(changes).select(*df.columns)
    return out


def new_list_tasks(urls: DataFrame, tasks: DataFrame, rules: DataFrame, mode: str, now: int) -> DataFrame:
    """Tasks for urls that have none in this mode; frequency from the list rule, expiry relative to now."""
    missing = urls.join(tasks.where(F.col("mode") == mode).select(F.col("uid").alias("uuid")), "uuid", "left_anti")
    with_rule = missing.join(rules.select(F.col("uuid").alias("ruleId"), "frequency"), "ruleId", "left")
    return with_rule.select(
        F.lit(mode).alias("mode"), "pid", "sid", "tid", F.col("uuid").alias("uid"), F.lit(0).cast("long").alias("kid"),
        F.col("ruleId").alias("rid"), "url", F.coalesce(F.col("frequency").cast("string"), F.lit(DEFAULT_FREQUENCY)).alias("frequency"),
        F.when(F.col("expire") > 0, now + F.col("expire")).otherwise(0).cast("long").alias("expire")
    )


def _url_number(frequency: Column) -> Column:
    return F.coalesce(frequency.try_cast("int"), F.lit(int(DEFAULT_FREQUENCY)))


def _word_number(frequency: Column) -> Column:
    return F.nullif(frequency.cast("string"), F.lit("")).try_cast("int")


def reconciled(url_frequency: Column, word_frequency: Column, url_expire: Column, word_expire: Column) -> tuple[Column, Column]:
    """(frequency, expire) of a search task: the smaller frequency if the keyword has one; the smaller expiry if both are set, else the one that is."""
    frequency = F.least(_url_number(url_frequency), _word_number(word_frequency))
    expire = F.coalesce(F.least(F.nullif(url_expire, F.lit(0)), F.nullif(word_expire, F.lit(0))), F.lit(0))
    return frequency.cast("string"), expire.cast("long")


def _search_rows(pairs: DataFrame, mode: str, now: int) -> DataFrame:
    """Search tasks of pairs of _url_side_of_pairs and _word_side: as `reconciled`, but what one side alone decides is read before the pairs are made."""
    expire = F.coalesce(F.least("_ue", "_we"), F.lit(0))
    return pairs.select(
        F.lit(mode).alias("mode"), "pid", "sid", "tid", "uid", "kid", F.col("ruleId").alias("rid"), "url",
        F.least("_uf", "_wf").cast("string").alias("frequency"), F.when(expire > 0, now + expire).otherwise(0).cast("long").alias("expire")
    )


def _url_side_of_pairs(urls: DataFrame, rules: DataFrame) -> DataFrame:
    found = urls.withColumnRenamed("uuid", "uid").join(rules.select(F.col("uuid").alias("ruleId"), "frequency"), "ruleId", "left")
    return found.withColumns({"_uf": _url_number(F.col("frequency")), "_ue": F.nullif("expire", F.lit(0))}).drop("frequency", "expire")


def _word_side(keywords: DataFrame) -> DataFrame:
    return keywords.select(
        F.col("uuid").alias("kid"), F.coalesce("tid", F.lit(0)).alias("_word_tid"), _word_number(F.col("frequency")).alias("_wf"),
        F.nullif("expire", F.lit(0)).alias("_we")
    )


def _with_each(rows: DataFrame, others: DataFrame, key: str, *on: str) -> DataFrame:
    """Every row with every one of the others (of equal columns `on`), which are repeated for each deal of the rows; deals follow the number of rows."""
    deals = max(SPREAD, math.ceil(rows.count() / DEAL_ROWS))
    # dealt before the join too: where the others are few Spark joins the rows as they lie, be it in one task
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(key), F.lit(deals)).cast("int")).repartition(deals, key)
    repeated = others.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    return dealt.join(repeated, [*on, "_deal"]).drop("_deal")


def reconciled_tasks(urls: DataFrame, keywords: DataFrame, rules: DataFrame, mode: str, now: int) -> DataFrame:
    """Search tasks of the urls with the keywords of their own task; global keywords are left out."""
    words = _word_side(keywords).where("_word_tid <> 0").withColumnRenamed("_word_tid", "tid")
    return _search_rows(_with_each(_url_side_of_pairs(urls, rules), words, "uid", "tid"), mode, now)


def new_search_tasks_by_url(urls: DataFrame, keywords: DataFrame, tasks: DataFrame, rules: DataFrame, mode: str, now: int) -> DataFrame:
    """url x its keywords (those of its task and the global ones, tid 0 or NULL) for urls without any task in this mode.

    The keywords of a task, and the global ones, which every url needs, are repeated for each deal of the urls, so
    that the pairs are made in as many tasks.
    """
    fresh = _url_side_of_pairs(urls, rules).join(tasks.where(F.col("mode") == mode).select("uid"), "uid", "left_anti")
    words = _word_side(keywords)
    own = _with_each(fresh, words.where("_word_tid <> 0").withColumnRenamed("_word_tid", "tid"), "uid", "tid")
    shared = _with_each(fresh, words.where("_word_tid = 0").drop("_word_tid"), "uid")
    return _search_rows(own.unionByName(shared), mode, now)


def new_search_tasks_by_keyword(
    keywords: DataFrame, task_types: DataFrame, urls: DataFrame, tasks: DataFrame, rules: DataFrame, mode: str, now: int
) -> DataFrame:
    """keyword x urls of the search tasks it belongs to (tid 0 or NULL: all of `task_types` (tid)), without the (uid, kid) that exist.

    The keywords that a url has are an array in its row, so the pairs are told from them where they are made and never move.
    """
    words = _word_side(keywords)
    known = task_types.select("tid").distinct()
    reached = words.where("_word_tid <> 0").withColumnRenamed("_word_tid", "tid").join(known, "tid", "left_semi")
    reached = reached.unionByName(_with_each(known, words.where("_word_tid = 0").drop("_word_tid"), "tid"))
    have = tasks.where(F.col("mode") == mode).groupBy("uid").agg(F.collect_set("kid").alias("_have"))
    wanted = _url_side_of_pairs(urls, rules).join(known, "tid", "left_semi").join(have, "uid", "left")
    pairs = _with_each(wanted, reached, "uid", "tid").where(~F.coalesce(F.array_contains("_have", F.col("kid")), F.lit(False)))
    return _search_rows(pairs, mode, now)


def match_list_rule(tasks: DataFrame, urls: DataFrame, rules: DataFrame) -> DataFrame:
    """tasks with (action, reason, fetch_url, base_url): ok, delete, disable or error."""
    joined = _with_rule(tasks.join(_url_side(urls), "uid", "left"), rules)
    action, reason = _judge()
    return joined.select(
        *tasks.columns, action.alias("action"), reason.alias("reason"),
        F.coalesce(F.nullif("_jsonUrl", F.lit("")), "_url").alias("fetch_url"), F.col("_url").alias("base_url")
    )


def match_search_rule(tasks: DataFrame, keywords: DataFrame, urls: DataFrame, rules: DataFrame) -> DataFrame:
    """As match_list_rule, with the keyword first: a missing one deletes, an inactive one disables; adds the word."""
    words = keywords.select(F.col("uuid").alias("kid"), F.col("word").alias("_word"), F.col("status").alias("_word_status"))
    joined = _with_rule(tasks.join(words, "kid", "left").join(_url_side(urls), "uid", "left"), rules)
    action, reason = _judge(
        F.when(F.col("_word").isNull(), F.struct(F.lit("delete").alias("a"), F.lit("keyword missing").alias("r"))).when(
            F.col("_word_status") != 1, F.struct(F.lit("disable").alias("a"), F.lit("keyword inactive").alias("r"))
        )
    )
    return joined.select(
        *tasks.columns, action.alias("action"), reason.alias("reason"), F.col("_word").alias("word"),
        F.coalesce(F.nullif("_jsonUrl", F.lit("")), "_url").alias("fetch_url"), F.col("_url").alias("base_url")
    )


def _url_side(urls: DataFrame) -> DataFrame:
    return urls.select(
        F.col("uuid").alias("uid"), F.lit(True).alias("_has_url"), F.col("url").alias("_url"), F.col("jsonUrl").alias("_jsonUrl"),
        F.col("status").alias("_url_status"), F.col("ruleStatus").alias("_rule_status"), F.col("ruleId").alias("_ruleId")
    )


def _with_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with the list rule of `_ruleId`; rows without a rule id are dealt by their url id, so that they do not meet in one task."""
    none = -1 - F.pmod(F.xxhash64("uid"), F.lit(1024))
    side = rules.select(F.col("uuid").alias("_key"), F.lit(True).alias("_has_rule"), F.col("status").alias("_list_status")).where("_key > 0")
    return rows.withColumn("_key", F.coalesce(F.nullif("_ruleId", F.lit(0)), none)).join(side, "_key", "left").drop("_key")


def _judge(first: Column | None = None) -> tuple[Column, Column]:
    def say(a: str, r: str) -> Column:
        return F.struct(F.lit(a).alias("a"), F.lit(r).alias("r"))

    chain = (
        F.when(F.col("_has_url").isNull(), say("delete", "url missing"))
        .when((F.col("_url_status") != 1) | (F.col("_rule_status") != 1), say("disable", "url inactive"))
        .when(F.col("_ruleId").isNull() | (F.col("_ruleId") == 0), say("error", "no rule"))
        .when(F.col("_has_rule").isNull(), say("delete", "rule missing"))
        .when(F.col("_list_status") != 1, say("error", "rule inactive"))
        .otherwise(say("ok", ""))
    )
    chain = F.coalesce(first, chain) if first is not None else chain
    return chain["a"], chain["r"]


def search_url(
    url: Column, word: Column, now: Column | int, key: str | None = None, mode: str = "format", post: bool = False, hour_offset: int = 36000
) -> Column:
    """URL with its slots filled: the keyword ({key}, or a query key in mode `get`; quoted unless posted) and {lastmonth}, {lastweek}, {yesterday}, {lasthour}, {now} as epoch seconds."""
    now = (now if isinstance(now, Column) else F.lit(now)).cast("long")
    out = url
    if key:
        out = build_query(out, {key: word}) if mode == "get" else F.replace(out, F.lit("{" + key + "}"), word if post else quote_plus(word))
    for name, back in (("lastmonth", 30 * 86400), ("lastweek", 7 * 86400), ("yesterday", 86400), ("lasthour", hour_offset), ("now", 0)):
        out = F.replace(out, F.lit("{" + name + "}"), (now - back).cast("string"))
    return out


def page_requests(df: DataFrame, url: str, slot: Mapping, page_column: str = "page", out: str = "page_url") -> DataFrame:
    """A row for every page of every url.

    slot: key, value (first number), step, max, mode (`get`, `format`, `replace`, `path`), prefix, suffix, pad (fixed width)
    and first (whether page 1 carries the slot too).
    """
    pages = df.withColumn(page_column, F.explode(F.sequence(F.lit(1), F.lit(int(slot["max"])))))
    number = (F.lit(int(slot.get("value", 1))) + (F.col(page_column) - 1) * int(slot.get("step", 1))).cast("string")
    if slot.get("pad"):
        number = F.lpad(number, int(slot["pad"]), "0")
    text = F.concat(F.lit(slot.get("prefix", "")), number, F.lit(slot.get("suffix", "")))
    paged = put_slot(F.col(url), slot.get("key", "page"), text, slot.get("mode", "get"))
    return pages.withColumn(out, paged if slot.get("first") else F.when(F.col(page_column) == 1, F.col(url)).otherwise(paged))


def put_slot(url: Column, key: str, value: Column, mode: str = "get") -> Column:
    """Put a value into a URL: query key, {name}, regular expression or path end; white space removed at the end."""
    if mode == "get":
        out = build_query(url, {key: value})
    elif mode == "format":
        out = F.replace(url, F.lit("{" + key + "}"), value)
    elif mode == "replace":
        out = F.regexp_replace(url, F.lit(key), value)
    else:
        out = F.concat(F.regexp_replace(url, "/$", ""), F.lit("/"), value)
    return F.regexp_replace(out, r"\s+", "")


def close_runs(runs: DataFrame, tasks: DataFrame, now: int) -> DataFrame:
    """Tasks after their runs: the last RUNS_KEPT run ids, crawltime now; frequency 0 ends the task (status 0).  runs: (task uuid, run)."""
    ranked = runs.select("uuid", "run").distinct().withColumn(
        "_k", F.row_number().over(Window.partitionBy("uuid").orderBy(F.desc("run")))
    ).where(F.col("_k") <= RUNS_KEPT)
    kept = ranked.groupBy("uuid").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    joined = tasks.drop("runs").join(kept, "uuid", "left")
    ran = F.col("runs").isNotNull()
    return joined.withColumns(
        {
            "crawltime": F.when(ran, F.lit(now)).otherwise(F.col("crawltime")).cast("long"),
            "status": F.when(ran & (F.col("frequency") == "0"), 0).otherwise(F.col("status"))
        }
    )


def rebuild_items(
    articles: DataFrame, mode_by_media: Mapping[int, str] | None = None, default_mode: str = "item"
) -> tuple[DataFrame, DataFrame]:
    """(updates, messages) of articles not yet fetched: script urls get status -1, others a message (mode by media type, rid)."""
    mode = F.lit(default_mode)
    for media, name in (mode_by_media or {}).items():
        mode = F.when(F.col("mediaType") == media, F.lit(name)).otherwise(mode)
    fresh = articles.where("status = 0")
    script = F.coalesce(F.startswith(F.lower("url"), F.lit("javascript")), F.lit(False))
    return fresh.where(script).select("rid", F.lit(-1).alias("status")), fresh.where(~script).select(
        mode.alias("mode"), "rid", "mediaType", "acid"
    )
