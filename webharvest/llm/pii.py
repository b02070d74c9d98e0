"""Personal data: base patterns, then bootstrapped contextual extraction.

The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers.  These seeds induce
lexical patterns, one or two words in front of them or a word on either side; patterns and the identifier-like tokens they extract form a graph,
on which confidence is spread for a few rounds (a pattern is as good as its instances, an instance as its
patterns); confident patterns then mark identifiers of no known form.  DataFrame functions only.

Positions are code points, from the lengths of the pieces between matches.  The regular expressions are the
plain ones with possessive quantifiers and a look-behind that skips starts inside a run, which changes no
match and keeps matching linear and free of deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import let
from ._tables import cut

#: kind -> (pattern, a string that every match contains or None)
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"(?<![0-9])[0-9](?:[ -]?[0-9])++", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}
FOUND = "id"
#: Identifier-like: a token with a digit; the parts that count are checked in _plausible.
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,left:string,second:string,right:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    def add(acc: Column, d: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(n)).alias("sum"), (~acc["odd"]).alias("odd"))

    each = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    return F.aggregate(each, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add)["sum"] % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."),
            lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255"))
        )
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _plausible(value: Column) -> Column:
    return (F.length(value) >= 6) & (F.length(_digits(value)) >= 3)


def _last_tokens(piece: Column) -> Column:
    """The last two tokens of a text as array (last, the one before), lower case, however long; empty ones where there are none.

    The last 64 code points are looked at first, the whole reversed text only where a token may begin before them.
    """
    short = F.substring(piece, -64, 64)
    two = r"\s(\S+)\s+(\S+)\s*\z"
    back = r"^\s*(\S*)(?:\s+(\S*))?"

    def found(x: Column) -> Column:
        near = F.array(F.regexp_extract(x["short"], two, 2), F.regexp_extract(x["short"], two, 1))
        whole = let(
            F.reverse(x["piece"]), lambda r: F.array(F.reverse(F.regexp_extract(r, back, 1)), F.reverse(F.regexp_extract(r, back, 2)))
        )
        return F.transform(F.when(F.regexp_like(x["short"], F.lit(two)), near).otherwise(whole), lambda t: F.lower(t))

    return let(F.struct(piece.alias("piece"), short.alias("short")), found)


def matches(text: Column, pattern: str, kind: str, rank: int, holds: str | None = None) -> Column:
    """All matches of a pattern, an array of spans, with the tokens before and after each (lower case, whole)."""
    values, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["value"])
        tokens = _last_tokens(x["piece"])
        right = F.lower(F.regexp_extract(x["after"], r"^\s*(\S*)", 1))
        span = let(
            tokens,
            lambda t: F.struct(
                start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"),
                t[0].alias("left"), t[1].alias("second"), right.alias("right"),
            ),
        )
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    def placed(x: Column) -> Column:
        return F.transform(
            x["values"], lambda v,
            i: F.struct(v.alias("value"), F.get(x["pieces"], i).alias("piece"), F.get(x["pieces"], i + 1).alias("after"))
        )

    pairs = let(F.struct(values.alias("values"), pieces.alias("pieces")), placed)
    none = F.array().cast(SPAN)
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.contains(text, F.lit(holds)), found).otherwise(none) if holds else found


def base_spans(text: Column) -> Column:
    """The valid base matches of all kinds, by start, then kind."""
    def valid(rank: int, kind: str) -> Column:
        return F.filter(matches(text, BASE[kind][0], kind, rank, BASE[kind][1]), lambda s: _valid(kind, s["value"]))

    return F.array_sort(F.concat(*(valid(rank, kind) for rank, kind in enumerate(BASE))))


def candidate_spans(text: Column, base: Column) -> Column:
    """Identifier-like tokens apart from the base spans, trimmed of closing punctuation."""
    def trimmed(s: Column) -> Column:
        value = F.regexp_replace(s["value"], r"[.,;:!?)\]}'\"]+$", "")
        return F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), (s["start"] + F.length(value)).alias("end"), s["kind"].alias("kind"),
            value.alias("value"), s["left"].alias("left"), s["second"].alias("second"), s["right"].alias("right")
        )

    tokens = F.transform(matches(text, CANDIDATE, FOUND, len(BASE)), trimmed)
    return F.filter(tokens, lambda s: _plausible(s["value"]) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, doc_id, base, candidates) of every row; row_key is a hash of id and text, so repeated rows share it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), text.alias("text"))
    with_base = rows.withColumn(
        "base", F.when(F.regexp_like("text", F.lit("[0-9@]")), base_spans(F.col("text"))).otherwise(F.array().cast(SPAN))
    )
    candidates = F.when(
        F.regexp_like("text", F.lit("[0-9]")), candidate_spans(F.col("text"), F.col("base"))
    ).otherwise(F.array().cast(SPAN))
    return with_base.select("row_key", "doc_id", "base", candidates.alias("candidates"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits of id and text, in hex."""
    parts = [F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))]
    return F.concat(F.hex(F.xxhash64(*parts)), F.lit("."), F.hex(F.xxhash64(F.lit("second"), *parts)))


def contexts(span: Column) -> Column:
    """The lexical patterns of a span, array of strings: the word before it, the two words before it, the words on both sides."""
    left, second, right = span["left"], span["second"], span["right"]
    pair = F.when(second != "", F.concat(second, F.lit(" "), left, F.lit(" _")))
    around = F.when(right != "", F.concat(left, F.lit(" _ "), right))
    return F.when(left == "", F.array().cast("array<string>")).otherwise(
        F.filter(F.array(F.concat(left, F.lit(" _")), pair, around), lambda p: p.isNotNull())
    )


def patterns(scanned: DataFrame, rounds: int = 3, smoothing: float = 1.0) -> DataFrame:
    """(pattern, confidence, instances, seeds) of every lexical pattern, after `rounds` of scoring on the pattern-instance graph."""
    spans = scanned.select(F.explode(F.concat("base", "candidates")).alias("s"))
    edges = spans.select(
        F.explode(contexts(F.col("s"))).alias("pattern"), F.lower("s.value").alias("value"),
        (F.col("s.kind") != FOUND).cast("double").alias("seed")
    )
    edges = cut(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    scores = edges.withColumn("score", F.col("seed"))
    found = None
    for _ in range(rounds):
        found = cut(
            scores.groupBy("pattern").agg(
                (F.sum("score") / (F.count("*") + smoothing)).alias("confidence"), F.count("*").alias("instances"),
                F.sum("seed").alias("seeds")
            )
        )
        value = edges.where("seed = 0").join(found, "pattern").groupBy("value").agg(F.avg("confidence").alias("score"))
        scores = edges.join(value, "value", "left").withColumn("score", F.greatest("seed", F.coalesce("score", F.lit(0.0))))
    return found


def discovered(scanned: DataFrame, *, confidence: float = 0.6, support: int = 3) -> DataFrame:
    """(row_key, extra): spans of unseen identifiers that patterns of at least this confidence and number of seeds extract."""
    good = patterns(scanned).where((F.col("confidence") >= confidence) & (F.col("seeds") >= support)).select("pattern")
    spans = scanned.select("row_key", F.explode("candidates").alias("s")).withColumn("pattern", F.explode(contexts(F.col("s"))))
    return spans.join(good, "pattern").groupBy("row_key").agg(F.array_sort(F.collect_set("s")).alias("extra"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", confidence: float = 0.6, support: int = 3) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_found, base_sha256, spans), a row for every row of `docs`.

    base_sha256: of the base spans, kind:start:end by start, then kind, comma-joined; spans: all spans, likewise.
    Null texts count as empty and have no spans.  Spans of different kinds may overlap; discovered ones overlap
    no base span.
    """
    scanned = cut(scan(docs, id_col, text_col))
    extra = discovered(scanned, confidence=confidence, support=support)
    both = scanned.select("row_key", "doc_id", "base").join(extra, "row_key", "left").withColumn(
        "extra", F.coalesce("extra", F.array().cast(SPAN))
    )

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return both.select(
        "doc_id", *map(count, BASE), F.size("extra").cast("long").alias("n_found"), F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.array_sort(F.concat("base", "extra"))).alias("spans")
    )


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", confidence: float = 0.6, support: int = 3) -> DataFrame:
    """`docs` with every span of personal data written as [KIND]; overlapping spans become one, named by the first.

    Null texts stay null; the columns are those of `docs`, whatever their names.
    """
    key, marks = (_free(name, docs.columns) for name in ("pii_key", "pii_spans"))
    scanned = cut(scan(docs, id_col, text_col).drop("doc_id").dropDuplicates(["row_key"]))
    extra = discovered(scanned, confidence=confidence, support=support)
    both = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(SPAN))))
    spans = scanned.join(extra, "row_key", "left").select(F.col("row_key").alias(key), both.alias(marks)).where(F.size(marks) > 0)
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(
        F.col(marks), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    )
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(spans, key, "left")
    return joined.withColumn(text_col, F.when(F.col(marks).isNull(), text).otherwise(clean)).select(*docs.columns)


def _free(name: str, taken: list[str]) -> str:
    """`name`, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
