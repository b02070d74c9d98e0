"""Licence scans by canonical digest.

Texts are normalised (case, punctuation, copyright lines, equivalent spellings), and the digest of an entire
text, and of each entire line, is hash-joined to the digests of known licence texts.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import let
from ._tables import cut

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: (licence, text): short texts and notices; collection() adds the standard texts.
KNOWN = (
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("0BSD", "Zero-Clause BSD\n\n" + _0BSD),
    ("0BSD", _0BSD),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: Standard licence texts, a file each: <licence>.txt, or <licence>.<variant>.txt.
TEXTS = Path(__file__).parent / "known_licenses"
#: Names of licences in notices.
NAMES = {
    "MIT": ("MIT License", "MIT"), "0BSD": (
        "Zero-Clause BSD License", "BSD Zero Clause License"
    ), "ISC": ("ISC License",), "Unlicense": ("Unlicense",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": (
        "BSD 3-Clause License", "New BSD License", "Modified BSD License"
    ),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"), "MPL-2.0": (
        "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"
    ),
    "Artistic-1.0": ("Artistic License 1.0",), "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
}
for _id, _name, _versions in (
    ("GPL", "GNU General Public License", "2.0 3.0"), ("LGPL", "GNU Lesser General Public License", "2.1 3.0"),
    ("AGPL", "GNU Affero General Public License", "3.0"), ("GFDL", "GNU Free Documentation License", "1.3")
):
    for _v in _versions.split():
        NAMES[f"{_id}-{_v}"] = tuple(
            x for v in {_v: 0, _v.removesuffix(".0"): 0} for x in (
                f"{_name}, version {v}", f"{_name} version {v}", f"{_name} v{v}", f"{_id} {v}", f"{_id}v{v}"
            )
        )
for _id, _name in (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")
):
    NAMES[f"CC-{_id}-4.0"] = (
        f"CC {_id} 4.0", f"Creative Commons {_name} 4.0", f"Creative Commons {_name} 4.0 International License",
        f"Creative Commons {_name} 4.0 International"
    )
FORMS = (
    "License: {}",
    *(
        f"{subject}{verb} under {the}{{}}{tail}" for subject,
        verbs in (
            ("", "Licensed Released Distributed"), ("This work is ", "licensed"), ("This software is ", "licensed released distributed"),
            ("This project is ", "licensed"), ("This file is ", "licensed")
        ) for verb in verbs.split() for the in ("", "the ", "a ") for tail in ("", " license")
    )
)
#: First lines of the standard headers of source files.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
)
#: (pattern, replacement), applied in order to lower-cased text; patterns that Java and RE2 read alike.
SPELLINGS = (
    ("licenc", "licens"), (r"\borganis", "organiz"), (r"\brecognis", "recogniz"), (r"\bfavour", "favor"),
    (r"\bcopyright holders\b", "copyright owners"), (r"\bnon[ -]infringement\b", "noninfringement")
)
#: Those of two words, which a line break can part; they are applied to joined lines once more.
PARTED = SPELLINGS[-2:]
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright\b[ \t]*(?:\(c\)|©|[0-9])|\(c\)|©|all rights reserved)[^\n]*$"
#: A text without any of these is not touched by SPELLINGS and COPYRIGHT_LINE; a joined one without any of the second row not by PARTED.
HINTS = ("licenc", "organis", "recognis", "favour", "copyright", "(c)", "©", "all rights reserved", "infringement")
PARTED_HINTS = ("copyright holders", "infringement")
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}\n]+"
#: Known texts up to which lines are compared with their hashes before they are joined; above it all lines are.
MOST_HASHES = 20_000


def collection() -> list[tuple[str, str]]:
    """(licence, text) of KNOWN, the standard texts, their headers and the usual wordings of notices."""
    files = [(f.name.removesuffix(".txt").removesuffix(".Regents"), f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    notices = [(name, form.format(x)) for name, names in NAMES.items() for x in names for form in FORMS]
    return [
        *KNOWN, *files, *HEADERS, *notices,
        *((name, f"SPDX-License-Identifier: {x}") for name in NAMES for x in (name, f"{name}-only", f"{name}-or-later"))
    ]


def _replaced(text: Column, spellings: tuple, hints: tuple[str, ...], first: tuple = ()) -> Column:
    """Patterns applied in order, only where a text has a hint of one: a search for plain strings is far cheaper."""

    def apply(t: Column) -> Column:
        out = t
        for old, new in (*first, *spellings):
            out = F.regexp_replace(out, old, new)
        return F.when(reduce(or_, (F.contains(t, F.lit(h)) for h in hints)), out).otherwise(t)

    return let(text, apply)


def _joined(lines: Column) -> Column:
    """The canonical text of canonical lines."""
    return _replaced(F.array_join(lines, " "), PARTED, PARTED_HINTS)


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, blank ones left out; null counts as empty."""
    out = _replaced(F.lower(F.coalesce(text, F.lit(""))), SPELLINGS, HINTS, ((COPYRIGHT_LINE, ""),))
    lines = F.split(F.regexp_replace(out, PUNCTUATION, " "), "\n", -1)
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def known_texts(spark: SparkSession, known=None) -> DataFrame:
    """(text, license): the known texts in canonical form; one shared by two licences keeps the first name."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(
        list(collection() if known is None else known), "license string, text string"
    )
    return rows.select(
        _joined(canonical_lines(F.col("text"))).alias("text"), "license"
    ).where("text <> ''").groupBy("text").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known=None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, license, notices), a row for every row of `docs`.

    license: the known licence that the entire text is, else null; notices: the licences that entire lines are,
    sorted, distinct, comma-joined, empty if none.  Texts without words have the digest of an empty text, which
    no known text has.  Rows of one id share their notices.  Every text is normalised once; of its lines only
    those with the hash of a known text go on to the join.
    """
    texts = cut(known_texts(docs.sparkSession, known))
    digests = texts.select(F.sha2("text", 256).alias("digest"), "license")
    hashes = [r[0] for r in texts.select(F.xxhash64("text")).limit(MOST_HASHES + 1).collect()]
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    likely = F.filter("lines", lambda x: F.xxhash64(x).isin(*hashes)) if len(hashes) <= MOST_HASHES else F.col("lines")
    each = F.array_distinct(F.transform(likely, lambda x: F.sha2(x, 256)))
    whole = cut(lines.select("doc_id", F.sha2(_joined(F.col("lines")), 256).alias("text_sha256"), each.alias("each")))
    notices = whole.select("doc_id", F.explode("each").alias("digest")).join(digests, "digest").groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices")
    )
    named = whole.select("doc_id", "text_sha256").join(digests.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left")
    return named.join(notices, named["doc_id"].eqNullSafe(notices["doc_id"]), "left").select(
        named["doc_id"], "text_sha256", "license", F.coalesce("notices", F.lit("")).alias("notices")
    )


def oracle() -> str:
    """DuckDB SQL of scan_licenses(documents)."""

    def replaced(text: str, spellings: tuple) -> str:
        for old, new in spellings:
            text = f"regexp_replace({text}, '{old}', '{new}', 'g')"
        return text

    def lines(text: str) -> str:
        out = replaced(f"lower(coalesce({text}, ''))", ((COPYRIGHT_LINE, ""), *SPELLINGS))
        return f"list_filter(list_transform(string_split(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"

    joined = replaced("array_to_string(lines, ' ')", PARTED)
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in collection())
    return f"""
WITH k AS (SELECT sha256({joined}) AS digest, min(license) AS license FROM (SELECT license, {lines("text")} AS lines FROM (VALUES {values}) t(license, text)) GROUP BY 1),
l AS (SELECT doc_id, {lines("text")} AS lines FROM documents),
w AS (SELECT doc_id, sha256({joined}) AS text_sha256, lines FROM l),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM w) JOIN k USING (digest) GROUP BY doc_id)
SELECT w.doc_id, text_sha256, license, coalesce(notices, '') AS notices FROM w LEFT JOIN k ON digest = text_sha256 LEFT JOIN n ON n.doc_id = w.doc_id"""
