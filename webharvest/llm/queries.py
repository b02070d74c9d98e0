"""Registered queries of the corpus operators, on the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import cut
from .chat_format import ORACLE as CHAT_SQL
from .chat_format import format_chats, read_back
from .collocations import ORACLE as COLLOCATION_SQL
from .collocations import collocations
from .decontaminate import contaminated
from .fingerprints import edited_with_next, near_classes
from .jaccard_join import jaccard_join
from .lexical_search import ORACLE as SEARCH_SQL
from .lexical_search import ranked_search
from .licenses import oracle as license_sql
from .licenses import scan_licenses
from .mixing import mix_sources
from .pii import find_pii
from .quality import fit_classifier
from .token_counts import token_counts
from .url_filters import judge_urls
from .url_filters import oracle as url_sql
from .vector_groups import ORACLE as VECTOR_SQL
from .vector_groups import vector_groups


#: Rules of op10, as its contract lists them; the operator's own default (url_filters.RULES) blocks net/de/, which its test fixes.
URL_RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"),
    ("block", "org", "/es/")
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return fit_classifier(docs, _table(spark, sf_dir, "labels")).score(docs)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = cut(edited_with_next(_table(spark, sf_dir, "documents")))
    return prints.join(near_classes(prints.select("doc_id", "fingerprint")), "doc_id")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    extra = spark.sql(
        "SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role FROM range(2)"
    ).withColumn("text", F.lit(probe))
    return read_back(format_chats(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after a deletion at a quarter, a replacement at a half and an insertion at three quarters of each text."""
    n = F.length("text")
    quarter, half, late = F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int"), F.floor(3 * n / 4).cast("int")
    head = F.substring("text", 1, 12)
    edits = F.array(
        F.struct(quarter.alias("start"), F.least(quarter + 7, half).alias("stop"), F.lit("").alias("text")),
        F.struct(half.alias("start"), F.least(half + 10, late).alias("stop"), F.reverse(head).alias("text")),
        F.struct(late.alias("start"), late.alias("stop"), head.alias("text")),
    )
    return token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), rules=URL_RULES).drop("rate", "lower")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(_table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            op1_decontaminate, op2_quality, op3_jaccard_join, op4_licenses, op5_fingerprints, op6_chat_format, op7_token_counts, op8_pii,
            op9_mixing, op10_url_filters, op11_collocations, op12_vector_groups,
            op13_ranked_search
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_licenses": license_sql(), "op6_chat_format": CHAT_SQL, "op10_url_filters": url_sql(rules=URL_RULES), "op11_collocations": COLLOCATION_SQL,
        "op12_vector_groups": VECTOR_SQL, "op13_ranked_search": SEARCH_SQL
    }
