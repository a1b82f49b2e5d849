"""Operator 10 [native]: whole texts looked up among known licences by canonical digest. DataFrame functions only.

A text is made canonical: lower case, copyright lines out, every run of characters that are neither letters nor digits one space (line ends
stay until lines have been told apart), equivalent spellings alike. Its SHA-256 is then joined with those of the known texts: the full texts
in the folder `licenses` beside this module, short ones listed here, or any table of (license_id, text). Besides the text as a whole, each of its lines
is such a text, which finds notices like "Released under the ... License." in other prose.

Only what can match is made canonical: each known text has some word that the canonical form leaves as it is (see `marks`), and a text or line without any
of these words matches none; of the rest only those as long as a known one get a digest. Neither leaves out a match. Known texts are broadcast after their
rows have been counted; a larger table of them is joined by shuffle.

Defined results: null, empty and unmatched texts have no licence (null), an empty list and 0 notices; a notice on several lines counts each
time and is listed once, in order; copies are looked up each on its own; of two known texts with one canonical form the smaller name wins; an empty
table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BROADCAST = 100_000

#: Spellings that count as equal, after punctuation has become spaces.
SPELLINGS = [
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authoris", "authoriz"), ("behaviour", "behavior"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("initialis", "initializ"), ("organis", "organiz"), ("practise", "practice"), ("recognis", "recogniz"), ("utilis", "utiliz"),
    ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
]

#: Short public licence texts and notices, without their copyright lines.
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AUTHOR_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_REDISTRIBUTE = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_HOLDERS_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = [
    ("MIT", f"MIT License\n{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("MIT", f"{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("MIT-0", f"MIT No Attribution\n{_GRANT}.\n{_AS_IS}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_AUTHOR_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_AUTHOR_AS_IS}"),
    ("BSD-2-Clause", f"{_REDISTRIBUTE}\n{_HOLDERS_AS_IS}"),
    ("BSD-3-Clause", f"{_REDISTRIBUTE}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_HOLDERS_AS_IS}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("All-rights-reserved", "All rights reserved."),
]
COPYRIGHT = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$"
BETWEEN = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form with line ends, each line trimmed."""
    x = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, ""), BETWEEN, " ")
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, " ?\n ?", "\n")


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_lines(text), "[ \n]+", " "))


def full_texts(folder: str | Path | None = None) -> list[tuple[str, str]]:
    """(licence id, text) of each file of a folder of licence texts; by default of those that come with the library."""
    return [(p.stem, p.read_text()) for p in sorted(Path(folder or Path(__file__).parent / "licenses").glob("*.txt"))]


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(texts if texts is not None else KNOWN + full_texts(), "license_id string, text string")


def marks(texts: list[str], most: int = 100) -> list[str] | None:
    """Strings of which each text with one of these canonical forms holds one, but for case; None if words that tell are lacking.

    They are words of the canonical texts with all their spellings; those that most texts have come first, of at least six letters where there are such.
    Words that a spelling of several words makes are left out, and so are those with a k, for which there is a third letter beside k and K.
    """
    single = [(a, b) for a, b in SPELLINGS if " " not in a]
    apart = {w for a, b in SPELLINGS if " " in a for w in b.split()}
    words = []
    for t in texts:
        own = {w for w in t.split() if re.fullmatch("[a-jl-z]{3,}", w) and not any(m in w for m in apart)}
        words.append({w for w in own if len(w) > 5} or own)
    found: list[str] = []
    while words:
        if not all(words) or len(found) >= most:
            return None
        counts = Counter(w for own in words for w in own)
        best = max(counts, key=lambda w: (counts[w], len(w), w))
        words = [own for own in words if best not in own]
        spelled = [best]
        for a, b in single:
            spelled += [w.replace(b, a) for w in spelled if b in w]
        found += spelled
    return found


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs' doc_id with license_id (of the whole text), notices (sorted ids of licences whose whole text is one line) and n_notices."""
    known = known.where("text is not null").select("license_id", canonical(F.col("text")).alias("c")).where("c <> ''")
    known = known.groupBy(F.sha2("c", 256).alias("digest"), F.length("c").alias("size"), "c").agg(F.min("license_id").alias("license_id"))
    counted = known.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    few = counted["n"] <= MOST_BROADCAST
    words = marks([r["c"] for r in known.select("c").collect()]) if counted["n"] <= 5_000 else None
    sizes = F.array(*(F.lit(n) for n in counted["sizes"]))  # at most as many as a licence has characters
    digests = F.broadcast(known.select("digest", "license_id")) if few else known.select("digest", "license_id")

    some = docs.select("doc_id", "text")
    if words:
        some = some.where(F.col("text").rlike("(?i)" + "|".join(words)))
    form = some.select("doc_id", F.coalesce(canonical_lines(F.col("text")), F.lit("")).alias("x"))
    lines = F.filter(F.split("x", "\n"), lambda s: F.array_contains(sizes, F.length(s)))
    whole = F.trim(F.regexp_replace("x", "[ \n]+", " "))
    texts = form.select("doc_id", F.filter(F.array(whole), lambda s: F.array_contains(sizes, F.length(s))).alias("whole"), lines.alias("lines"))
    texts = texts.where("size(whole) + size(lines) > 0").select("doc_id", F.explode(F.concat(F.transform("whole", lambda s: F.struct(F.lit(True).alias("whole"), s.alias("s"))), F.transform("lines", lambda s: F.struct(F.lit(False).alias("whole"), s.alias("s"))))).alias("t"))
    hits = texts.select("doc_id", "t.whole", F.sha2("t.s", 256).alias("digest")).join(digests, "digest")
    hits = hits.groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notices"),
        F.count_if(~F.col("whole")).alias("n_notices"),
    )
    return docs.select("doc_id").join(hits, "doc_id", "left").select("doc_id", "license_id", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _oracle() -> str:
    def lines(text: str) -> str:
        x = f"regexp_replace(regexp_replace(lower({text}), {_quoted(COPYRIGHT)}, '', 'g'), {_quoted(BETWEEN)}, ' ', 'g')"
        for a, b in SPELLINGS:
            x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
        return f"regexp_replace({x}, ' ?\\n ?', chr(10), 'g')"

    def whole(text: str) -> str:
        return f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))"

    values = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN + full_texts())
    return f"""
WITH known AS (SELECT min(license_id) AS license_id, c FROM (SELECT license_id, {whole(lines("text"))} AS c FROM (VALUES {values}) v(license_id, text)) WHERE c <> '' GROUP BY c),
form AS (SELECT doc_id, coalesce({lines("text")}, '') AS x FROM documents),
texts AS (SELECT doc_id, true AS whole, {whole("x")} AS c FROM form UNION ALL SELECT doc_id, false, unnest(string_split(x, chr(10))) FROM form),
hits AS (SELECT doc_id, min(CASE WHEN whole THEN license_id END) AS license_id,
  coalesce(string_agg(DISTINCT CASE WHEN NOT whole THEN license_id END, ',' ORDER BY CASE WHEN NOT whole THEN license_id END), '') AS notices, count(*) FILTER (WHERE NOT whole) AS n_notices
  FROM texts JOIN known USING (c) GROUP BY doc_id)
SELECT doc_id, license_id, coalesce(notices, '') AS notices, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices FROM documents LEFT JOIN hits USING (doc_id)
"""


ORACLE = _oracle()
