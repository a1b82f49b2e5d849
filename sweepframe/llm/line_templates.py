"""Operator 5 [native]: recurring lines by a fixed-depth tree of log templates. DataFrame functions only.

Each line is masked (a token with a digit is a variable field) and put into a leaf of the tree by its token count and its first `depth`
tokens. Within a leaf a token that at least `min_texts` different texts have at its place is constant; the others, and masked ones, are variable fields.
A line's template is its leaf with its constant tokens. Of the tokens that aren't masked at least `percent` in a hundred must be constant, and one of
these must hold a letter; other templates generalise too far and count for nothing.

A template recurs if at least `min_texts` different texts have it. Near copies of one text share all their lines with each other and nothing else, and are left to
near-duplicate removal; so it counts if there is evidence of texts that have something of their own. Either at least `min_texts` of its texts are carriers, whose
recurring lines make up at most half of their characters; or its texts are at least that different in their company: a text's company for a template
is, of two or more other recurring templates, the one that most texts have (the first in it of equals), otherwise the rest of its lines as they stand, if any. Near copies
keep company with a few templates of their family, however many they are; texts that share a boilerplate line or two keep company with their own lines, even
where the boilerplate is most of them. Every line of a template that counts is dropped, in whatever text it stands and however much of that text it is. Exact copies of a text count once, so copying a document makes none of its lines boilerplate.

Texts are tokenised once for the leaves; only lines of leaves that recur are tokenised again. Counts are of distinct (key, text) pairs, which are
pre-aggregated and spread over both columns, and no join is by template, leaf or token unless its hot keys have been broadcast (see key_filter), so one line
in a third of all documents is no single task.

Defined results: null text stays null and counts as no line; blank lines are never dropped; ties don't arise; repeated rows count once;
empty tables give empty results; extra columns are kept, and the two that are added can be named otherwise where their names are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.llm.common import key_filter, key_join, written

SPACE = r"\x09-\x0D\x20"
#: Documents with lines to drop, up to which their line numbers (some 50 bytes each) are broadcast.
MOST_BROADCAST = 400_000


def by_doc(docs: DataFrame, lines: DataFrame, column: str) -> DataFrame:
    """docs with the sorted line numbers of their lines (a written table of doc_id and pos); documents without any have null."""
    found = written(lines.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias(column)), "numbers")
    return docs.join(F.broadcast(found) if found.count() <= MOST_BROADCAST else found, "doc_id", "left")


def tokens_of(line: Column) -> Column:
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, f"[^{SPACE}0-9]*+[0-9][^{SPACE}]*", "<*>")).otherwise(line)
    return F.regexp_extract_all(masked, F.lit(f"[^{SPACE}]+"), F.lit(0))


def raw(line: str) -> Column:
    """A line as a number, to be added up: sums tell sets of lines apart."""
    return F.xxhash64(line).cast("decimal(38,0)").alias("raw")


def recurring(pairs: DataFrame, keys: list[str], min_texts: int) -> DataFrame:
    """The keys that at least min_texts different texts have, and n, how many."""
    return pairs.select(*keys, "text_key").distinct().groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_texts)


def recurring_lines(docs: DataFrame, min_texts: int, depth: int, percent: int, share: int) -> DataFrame:
    """(doc_id, pos) of the lines whose template recurs."""
    docs = docs.where("text is not null")
    text_key = F.xxhash64("text").alias("text_key")
    lines = docs.select("doc_id", text_key, F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "text_key", "pos", raw("line"), tokens_of(F.col("line")).alias("tokens"))
    every = written(lines.where(F.size("tokens") > 0).select("doc_id", "text_key", "pos", "raw", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf")), "lines")
    leaves = written(recurring(every, ["leaf"], min_texts), "leaves")
    lines = written(key_filter(every.drop("raw"), leaves, "leaf"), "leaf-lines")

    # The lines of recurring leaves, token by token.
    own = by_doc(docs, lines, "at").where("at is not null").withColumn("lines", F.split("text", "\n"))
    own = own.select("doc_id", text_key, F.length("text").alias("size"), F.explode(F.transform("at", lambda p: F.struct(p.alias("pos"), F.get("lines", p).alias("line")))).alias("x"))
    own = own.select("doc_id", "text_key", "size", "x.pos", raw("x.line"), F.length("x.line").alias("n_chars"), tokens_of(F.col("x.line")).alias("tokens"))
    own = own.withColumn("leaf", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)))
    own = written(own, "candidates")
    tokens = own.select("doc_id", "pos", "text_key", "leaf", F.posexplode("tokens").alias("i", "token")).where("token <> '<*>'").withColumn("place", F.xxhash64("leaf", "i", "token"))
    constant = written(recurring(tokens, ["place"], min_texts), "constants")
    fixed = key_filter(tokens.select("doc_id", "pos", "i", "token", "place"), constant, "place").groupBy("doc_id", "pos")
    fixed = fixed.agg(F.count("*").alias("n_fixed"), F.bool_or(F.col("token").rlike(r"\p{L}")).alias("worded"), F.sort_array(F.collect_list(F.struct("i", "token"))).alias("fixed"))
    plain = F.size(F.filter("tokens", lambda t: t != "<*>"))
    named = own.join(fixed.where("worded"), ["doc_id", "pos"]).where(F.col("n_fixed") * 100 >= plain * percent)
    named = written(named.select("doc_id", "pos", "n_chars", "size", "text_key", "raw", F.xxhash64("leaf", "fixed").alias("template")), "templates")

    often = written(recurring(named, ["template"], min_texts), "often")
    found = written(key_filter(named, often, "template"), "found")
    shares = found.groupBy("doc_id").agg(F.sum("n_chars").alias("chars"), F.first("size").alias("size"))
    carriers = written(shares.where(F.col("chars") * 100 <= F.col("size") * share).select("doc_id"), "carriers")
    carriers = F.broadcast(carriers) if carriers.count() <= 4 * MOST_BROADCAST else carriers
    carried = recurring(found.join(carriers, "doc_id", "left_semi"), ["template"], min_texts)

    # Each text's templates with how many texts have them, and the company of each.
    own = found.groupBy("doc_id", "text_key", "template").agg(F.min("pos").alias("at"), F.count("*").alias("lines"), F.sum("raw").alias("raw"))
    kinds = own.groupBy("template").agg(F.count("*").alias("n"))
    kinds = written(kinds.join(often.select("template", F.col("n").alias("texts")), "template"), "kinds")
    each = F.struct((-F.col("texts")).alias("texts"), "at", "template", "lines", "raw")
    ranked = key_join(own, kinds, ["template"]).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(each)).alias("templates"))
    total = every.groupBy("doc_id").agg(F.count("*").alias("all_lines"), F.sum("raw").alias("all_raw"))
    top = F.slice("templates.template", 1, 2)
    company = ranked.join(total, "doc_id").select("all_lines", "all_raw", F.size("templates").alias("kinds"), top.alias("top"), F.explode("templates").alias("t")).select("*", "t.template", "t.lines", "t.raw")
    other = F.when(F.col("top")[0] != F.col("template"), F.col("top")[0]).otherwise(F.get("top", F.lit(1)))
    company = company.select("template", F.when(F.col("kinds") > 2, F.xxhash64(other)).when(F.col("all_lines") > F.col("lines"), F.xxhash64(F.col("all_raw") - F.col("raw"))).alias("text_key")).where("text_key is not null")
    boilerplate = written(carried.unionByName(recurring(company, ["template"], min_texts)).groupBy("template").agg(F.max("n").alias("n")), "boilerplate")
    return key_filter(found, boilerplate, "template").select("doc_id", "pos")


def drop_lines(docs: DataFrame, min_texts: int = 10, depth: int = 3, percent: int = 70, share: int = 50, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with recurring lines taken out of text (n_chars, where there is such a column, follows) and two more columns, their lines and those dropped.

    A column of docs that has the name of one of the two is replaced by it.
    """
    found = written(recurring_lines(docs.select("doc_id", "text"), min_texts, depth, percent, share), "dropped")
    out = by_doc(docs, found, "__drop").withColumn("__lines", F.split("text", "\n"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drop")
    kept = F.array_join(F.transform(rest, lambda i: F.get("__lines", i)), "\n")
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(kept)
    columns = {"text": text, "n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {"text": text}
    return out.select(
        *(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns if c not in (n_lines, n_dropped)),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias(n_lines),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias(n_dropped),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text AS text_key, pos - 1 AS pos, split[pos] AS line FROM (
    SELECT doc_id, text, string_split(text, chr(10)) AS split, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL)),
toks AS (
  SELECT doc_id, text_key, pos, length(line) AS n_chars,
    regexp_extract_all(regexp_replace(line, '[^\x09-\x0D\x20]*[0-9][^\x09-\x0D\x20]*', '<*>', 'g'), '[^\x09-\x0D\x20]+') AS tokens FROM lines),
leafed AS (SELECT *, len(tokens) AS n_tokens, list_slice(tokens, 1, 3) AS head FROM toks WHERE len(tokens) > 0),
leaves AS (SELECT n_tokens, head FROM leafed GROUP BY ALL HAVING count(DISTINCT text_key) >= 10),
cand AS (SELECT leafed.*, len(list_filter(tokens, lambda t: t <> '<*>')) AS n_plain FROM leafed JOIN leaves USING (n_tokens, head)),
tk AS (SELECT doc_id, pos, text_key, n_tokens, head, unnest(range(0, len(tokens))) AS i, unnest(tokens) AS token FROM cand),
const AS (SELECT n_tokens, head, i, token FROM tk WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT text_key) >= 10),
fixed AS (SELECT doc_id, pos, count(*) AS n_fixed, bool_or(regexp_matches(token, '\p{L}')) AS worded, list({'i': i, 'token': token} ORDER BY i) AS fixed FROM tk JOIN const USING (n_tokens, head, i, token) GROUP BY doc_id, pos),
named AS (SELECT doc_id, pos, n_chars, text_key, n_tokens, head, fixed FROM cand JOIN fixed USING (doc_id, pos) WHERE worded AND n_fixed * 100 >= n_plain * 70),
often AS (SELECT n_tokens, head, fixed, count(DISTINCT text_key) AS texts FROM named GROUP BY ALL HAVING count(DISTINCT text_key) >= 10),
found AS (SELECT named.*, texts FROM named JOIN often USING (n_tokens, head, fixed)),
carriers AS (SELECT doc_id FROM found GROUP BY doc_id, text_key HAVING sum(n_chars) * 100 <= length(text_key) * 50),
kinds AS (SELECT doc_id, text_key, n_tokens, head, fixed, texts, min(pos) AS first_pos, list(pos) AS places FROM found GROUP BY ALL),
ranked AS (SELECT *, md5({'n': n_tokens, 'h': head, 'f': fixed}::VARCHAR) AS template, row_number() OVER (PARTITION BY doc_id ORDER BY texts DESC, first_pos) AS k, count(*) OVER (PARTITION BY doc_id) AS own_kinds FROM kinds),
rest AS (SELECT r.doc_id, r.template, md5(list(line ORDER BY line)::VARCHAR) AS rest FROM ranked r JOIN (SELECT doc_id, pos, line FROM lines SEMI JOIN leafed USING (doc_id, pos)) l ON l.doc_id = r.doc_id AND NOT list_contains(r.places, l.pos) WHERE own_kinds <= 2 GROUP BY ALL),
company AS (SELECT r.n_tokens, r.head, r.fixed, CASE WHEN r.own_kinds > 2 THEN 'template' || o.template ELSE 'rest' || rest.rest END AS company
  FROM ranked r LEFT JOIN ranked o ON o.doc_id = r.doc_id AND o.k = CASE WHEN r.k = 1 THEN 2 ELSE 1 END LEFT JOIN rest ON rest.doc_id = r.doc_id AND rest.template = r.template),
boilerplate AS (SELECT n_tokens, head, fixed FROM found JOIN carriers USING (doc_id) GROUP BY ALL HAVING count(DISTINCT text_key) >= 10
  UNION SELECT n_tokens, head, fixed FROM company GROUP BY ALL HAVING count(DISTINCT company) >= 10),
gone AS (SELECT doc_id, list(pos) AS gone FROM found JOIN boilerplate USING (n_tokens, head, fixed) GROUP BY doc_id),
parts AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS split, gone FROM documents d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(coalesce(len(split), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(split) + 1), lambda k: NOT list_contains(gone, k - 1)), lambda k: split[k]), chr(10)) END) AS kept_sha256
FROM parts
"""
