"""Article rows, merges, run counters and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import typeinfo

# Article statuses.
INIT, ACTIVE, PARSED, DELETED = 0, 1, 2, -1
_CRAWL_FIELDS = ("listMode", "mode", "stid", "uid", "pid", "sid", "tid", "kid", "listRule", "list_url", "list_crawl_id")


def crawl_info(df: DataFrame) -> Column:
    return F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in _CRAWL_FIELDS])


def article_rows(items: DataFrame, now: int, leftovers: Sequence[str] = ()) -> DataFrame:
    """Article of each list item (acid, url, title, pubtime, ...): pubtime at most now, domain and subdomain of the url, other fields in `result`."""
    info = typeinfo(F.col("url"))
    result = F.create_map(*[x for c in leftovers for x in (F.lit(c), F.col(c).cast("string"))]) if leftovers else F.lit(None).cast("map<string,string>")
    return items.select(
        "acid", "url", "title", F.least(
            F.col("pubtime"), F.lit(now).cast("long")
        ).alias("pubtime"), info["domain"].alias("domain"), info["subdomain"].alias("subdomain"),
        F.lit(INIT).alias("status"), result.alias("result"), crawl_info(items).alias("crawlinfo"), F.lit(now).cast("long").alias("ctime"), F.lit(0).cast("long").alias("utime"),
    )


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def merge_detail(articles: DataFrame, details: DataFrame, now: int) -> DataFrame:
    """articles (rid, title, author, channel, pubtime, content, status, utime) after details of the same rid.

    The title keeps the old one; author, channel and pubtime prefer the new one; pubtime falls back to the old
    one, then now.  Several details of a rid are one, each field from the latest that gives it (by pubtime, then by the
    other fields).  Status 2 if title, author, content and pubtime were all given, else 1; rows without detail stay.
    """
    names = ("title", "author", "channel", "pubtime", "content")
    latest = F.struct(F.coalesce("pubtime", F.lit(0)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    folded = details.groupBy("rid").agg(*[F.max_by(c, F.when(F.col(c) != (0 if c == "pubtime" else ""), latest)).alias(f"_{c}") for c in names])
    joined = articles.join(folded.withColumn("_has", F.lit(True)), "rid", "left")
    title, author, content = F.coalesce(_filled("title"), _filled("_title")), F.coalesce(_filled("_author"), _filled("author")), F.coalesce(
        _filled("_content"), _filled("content")
    )
    given = F.coalesce(F.nullif("_pubtime", F.lit(0)), F.nullif("pubtime", F.lit(0)))
    whole = title.isNotNull() & author.isNotNull() & content.isNotNull() & given.isNotNull()
    new = {
        "title": title, "author": author, "channel": F.coalesce(_filled("_channel"), _filled("channel")), "content": content,
        "pubtime": F.coalesce(given, F.lit(now)), "status": F.when(whole, PARSED).otherwise(ACTIVE), "utime": F.lit(now)
    }
    return joined.withColumns(
        {c: F.when(F.col("_has"), v).otherwise(F.col(c)).cast(articles.schema[c].dataType) for c, v in new.items()}
    ).select(*articles.columns)


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "acid", newest: str = "utime") -> DataFrame:
    """stored with incoming rows: of several incoming rows of a key the newest counts; its non-NULL fields replace stored ones, ctime stays."""
    fields = [c for c in stored.columns if c != key]
    last = incoming.groupBy(key).agg(
        F.max_by(
            F.struct(*[(F.col(c) if c in incoming.columns else F.lit(None).cast(stored.schema[c].dataType)).alias(c) for c in fields]),
            newest
        ).alias("_new")
    )
    joined = stored.join(last, key, "full_outer")
    return joined.select(
        key,
        *[(F.coalesce(F.col(c), F.col(f"_new.{c}")) if c == "ctime" else F.coalesce(F.col(f"_new.{c}"), F.col(c))).alias(c) for c in fields]
    ).select(*stored.columns)


def join_pages(pages: DataFrame, key: str = "rid", page: str = "page", content: str = "content", others: Sequence[str] = ()) -> DataFrame:
    """One row for each article of several pages: contents in page order joined by blank lines, other fields from the first page that has them."""
    order = F.array_sort(F.collect_list(F.when(F.col(content).isNotNull(), F.struct(page, content))))
    first = [F.min_by(c, F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.col(page))).alias(c) for c in others]
    return pages.groupBy(key).agg(F.array_join(F.transform(order, lambda x: x[content]), "\r\n\r\n").alias(content), *first)


def run_counters(pages: DataFrame, now: int) -> DataFrame:
    """Crawl log of each run from its pages (run, page, url, total, new_count): sums, repeats, pages, pages with nothing new, page -> url."""
    by_page = pages.groupBy("run", "page").agg(
        F.sum("total").alias("total"), F.sum("new_count").alias("new_count"), F.min("url").alias("url")
    )
    return by_page.groupBy("run").agg(
        F.sum("total").alias("total"), F.sum("new_count").alias("new_count"), F.sum(F.col("total") - F.col("new_count")).alias("repeat_count"), F.count("*").alias("page"),
        F.sum(F.when(F.col("new_count") == 0, 1).otherwise(0)).alias("repeat_page"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page").cast("string"), "url")))).alias("crawl_urls"),
    ).withColumn("crawl_end", F.lit(now).cast("long"))


def error_rows(errors: DataFrame, now: int) -> DataFrame:
    """Error log rows from (lid, tid, mode, frequency, url, class, msg)."""
    return errors.select(
        "lid", "tid", "mode", "frequency", "url", F.concat(F.col("class"), F.lit(": "), F.coalesce("msg", F.lit(""))).alias("error"), "msg",
        "class", F.lit(now).cast("long").alias("create_at")
    )


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("class").agg(F.count("*").alias("n"))


def daily_counts(articles: DataFrame, ctime: str = "ctime") -> DataFrame:
    return articles.groupBy(F.to_date(F.timestamp_seconds(ctime)).alias("day")).agg(F.count("*").alias("articles"))


def created_yesterday(articles: DataFrame, now: int) -> DataFrame:
    """Articles created on the day before `now` (one row); `ym` prunes the months of a partitioned table."""
    today = F.unix_timestamp(F.date_trunc("day", F.timestamp_seconds(F.lit(now))))
    rows = articles.where((F.col("ctime") >= today - 86400) & (F.col("ctime") < today))
    if "ym" in articles.columns:
        rows = rows.where(F.col("ym") == F.date_format(F.timestamp_seconds(today - 86400), "yyyyMM"))
    return rows.agg(F.count("*").alias("articles"))


def item_tasks(articles: DataFrame, handle: str = "url_handle") -> DataFrame:
    """(queue, message) of new articles: handle none sends nothing, result goes to the result queue, others to the item queue."""
    queue = F.when(F.col(handle) == "none", F.lit(None)).when(F.col(handle) == "result", "result").otherwise("item")
    return articles.select(queue.alias("queue"), F.to_json(F.struct("mode", "rid")).alias("message")).where("queue is not null")
