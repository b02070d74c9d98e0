"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACES = " \t\n\r\x0b\x0c"
# Chinese stopwords, matched as substrings.
STOPWORDS_ZH = (
    "的 一 不 在 人 有 是 为 以 于 上 他 而 后 之 来 及 了 因 下 可 到 由 这 与 也 此 但 并 个 其 已 无 小 我 们 起 最 再 今 去 好 只 又 或 很 亦 某 把 那 你 乃 它 吧 被 比 别 趁 当 从 到 得 打 凡 儿 尔 该 各 给 跟 和 何 还 即 几 既 看 据 距 靠 啦 了 "
    "另 么 每 们 嘛 拿 哪 那 您 凭 且 却 让 仍 啥 如 若 使 谁 虽 随 同 所 她 哇 嗡 往 哪 些 向 沿 哟 用 于 咱 则 怎 曾 至 致 着 诸 自 為 於 後 這 與 並 個 無 們 當 從 兒 爾 該 給 還 幾 麼 憑 卻 讓 誰 雖 喲 則 諸 中共 中央 主席 习近平"
).split()
#: Default stopwords of spaced languages, a short list of function words; longer lists are a parameter.
STOPWORDS = {
    "en": "a an and are as at be by for from has he in is it of on or that the this to was were which with".split(),
    "de": "auf das den der des die ein eine er es für im in ist mit nicht sich sie und von zu".split(),
    "fr": "au avec ce dans de des du elle en est et la le les on par pas pour que qui sur un une".split(),
    "es": "al con de del el en es la las los no para por que se su un una y".split(),
}


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def remove_spaces(text: Column) -> Column:
    """Without any ASCII white space."""
    return F.translate(text, SPACES, "")


def md5_hex(text: Column) -> Column:
    """Lower-case hex MD5 of the UTF-8 bytes; NULL for NULL."""
    return F.md5(F.encode(text, "utf-8"))


def base64_encode(text: Column) -> Column:
    """Base64 of the UTF-8 bytes in one line."""
    return F.replace(F.replace(F.base64(F.encode(text, "utf-8")), F.lit("\r")), F.lit("\n"))


def base64_decode(text: Column) -> Column:
    """Text of base64; NULL for what is not base64 of UTF-8 text."""
    return F.try_validate_utf8(F.try_to_binary(text, F.lit("base64")).cast("string"))


def normalise_lines(text: Column) -> Column:
    """Blank lines to one CRLF, tabs and style blocks dropped, ends trimmed."""
    out = F.regexp_replace(F.translate(text, "\t", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(F.regexp_replace(out, r"[\r\n]\s*[\r\n]*", "\r\n"), r"^\s+|\s+$", "")


def inner_trim(text: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_count(text: Column, lang: str = "en") -> Column:
    """Spaced languages: pieces between single white space characters; zh: characters."""
    return F.length(text) if lang == "zh" else F.size(F.split(remove_punctuation(text), r"\s", -1))


def stopword_count(text: Column, lang: str = "en", words: Sequence[str] | None = None) -> Column:
    """Spaced languages: words that are stopwords; zh: different stopwords that occur in the text."""
    if lang == "zh":
        return F.size(F.filter(F.array(*[F.lit(w) for w in dict.fromkeys(words or STOPWORDS_ZH)]), lambda w: F.contains(text, w)))
    known = list(words or STOPWORDS.get(lang, STOPWORDS["en"]))  # isin looks long lists up by hash
    return F.size(F.filter(F.split(F.lower(remove_punctuation(text)), r"\s", -1), lambda w: w.isin(*known)))


def stopwords_by_language(text: Column, lang: Column, lists: dict[str, Sequence[str]] | None = None) -> Column:
    """Stopword count with the list of each row's language; an unknown language takes English."""
    lists = {**STOPWORDS, "zh": STOPWORDS_ZH, **(lists or {})}
    out = stopword_count(text, "en", lists["en"])
    for name, words in lists.items():
        if name != "en":
            out = F.when(F.lower(F.substring(lang, 1, 2)) == name, stopword_count(text, name, words)).otherwise(out)
    return out


def stopword_lists(table: DataFrame, most: int = 20_000) -> dict[str, list[str]]:
    """The lists of a table (lang, word), for the `lists` parameters; a table of more than `most` words is refused, none is cut."""
    rows = table.where("lang is not null and word <> ''").select(
        F.lower(F.substring("lang", 1, 2)).alias("lang"), F.lower("word").alias("word")
    ).distinct()
    found = rows.groupBy("lang").agg(F.array_sort(F.collect_list("word")).alias("words"))
    if (size := rows.count()) > most:
        raise ValueError(f"{size} stopwords are over the limit of {most}")
    return {r["lang"]: r["words"] for r in found.collect()}


def frequent_words(texts: DataFrame, share: float = 0.25, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word): the words that stand in at least `share` of a language's texts, a stopword table made from a corpus."""
    words = F.array_distinct(F.filter(F.split(F.lower(remove_punctuation(F.col(text))), r"\s+"), lambda w: w != ""))
    rows = texts.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    totals = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("texts"))
    counts = rows.select(F.col(lang).alias("lang"), F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counts.join(totals, "lang").where(F.col("n") >= share * F.col("texts")).select("lang", "word")
