"""Quality rules: cross-document line frequency, with built-in functions only.

Lines are normalised (lower case, digits as 0, white space runs as one space, trimmed) and named by
a hash.  For every host and line the *different* documents are counted: documents with the same
normalised lines in the same order are copies and count once, there and in the host's total, so a group
of copies doesn't make its own lines frequent.
Lines over the limit are boilerplate; a document is rejected when the characters left after removing
them are too few a share of its own (*depleted*).

Scale: the text is read once for the per-document figures and the line table; lines travel as
(host, line hash, document sketch) rows that are combined before the shuffle, once to distinct rows dealt
by all three and once to counts, so a line in a third of all documents is pre-aggregated in every task.  Frequent lines
are few; they are joined to the lines by a join that the planner may broadcast by measured size or
split for skew.  Everything per text (duplicate lines, repeated word windows) stays inside its row.

Defined results: a null text has no words and no lines; a null host is a host of its own; a row is judged by its own host
and text alone, so null and repeated doc_ids change nothing and equal rows are judged alike; an empty table gives an
empty table; other columns are not read (``keep_good`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C


#: A line is boilerplate when more than this many different documents of a host hold it ...
LINE_DOCS = 50
#: ... and more than this share of the host's documents (per thousand).
LINE_SHARE = 20
#: A document is depleted when fewer characters than this share (per hundred) are left.
LEFT_SHARE = 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, C.GAP), "")


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text; all but the trimming is done on the whole text at once."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[1-9]", "0")
    lines = F.split(F.regexp_replace(text, C.UNEVEN, " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def rule_figures(docs: DataFrame, n: int = 8) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to rows with a ``text`` column."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_w", words(text))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
    held = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_l", held)
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    last = F.greatest(F.size("_w") - (n - 1), F.lit(0))
    step, cur = 1, "_w"
    while step < n:
        nxt = f"_h{step}"
        d = d.withColumn(nxt, F.zip_with(cur, F.slice(cur, F.lit(step + 1), F.greatest(F.size(cur) - step, F.lit(0))),
                                         lambda a, b: F.xxhash64(a, b)))
        cur, step = nxt, step * 2
    d = d.withColumn("_v", F.slice(F.col(cur), F.lit(1), last))
    again = F.size(F.array_distinct("_v")) < F.size("_v")
    sorted_ = F.array_sort(F.transform("_v", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(again, sorted_))
    pairs = F.zip_with("_s", F.slice("_s", F.lit(2), F.size("_s")), lambda a, b: F.when(
        a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    d = d.withColumn("_p", F.when(again, starts))
    cover = F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")), lambda a, b: F.least(F.lit(n), F.coalesce(b - a, F.lit(n))))
    d = d.withColumn("n_repeat_words", F.when(again, F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(
        F.lit(0).cast("long")))
    return d.drop("_w", "_l", "_v", "_s", "_p", *[f"_h{1 << i}" for i in range(n.bit_length()) if 1 << i < n])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def line_name(line: Column) -> Column:
    """A 60-bit hash of a line: the first 15 hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def lines_of(docs: DataFrame, host: str) -> DataFrame:
    """(host, tx, line, chars, sketch): normalised lines with a character, by hash; tx: the text's hash; sketch: a hash of all
    lines of the document in order.  A document without lines has one row with a null line."""
    named = F.transform(normal_lines(F.col("text")), lambda x: F.struct(line_name(x).alias("line"), F.char_length(x).alias("chars")))
    d = docs.select(F.col(host).alias("host"), F.xxhash64("text").alias("tx"), named.alias("x"))
    d = d.withColumn("sketch", F.xxhash64(F.col("x.line")))
    return d.select("host", "tx", "sketch", F.explode_outer("x").alias("x")).select("host", "tx", "x.line", "x.chars", "sketch")


def hosts_of(lines: DataFrame) -> DataFrame:
    """(h, docs): the different documents of every host."""
    return lines.select("host", "sketch").distinct().groupBy(F.col("host").alias("h")).agg(F.count("*").alias("docs"))


def frequent_lines(lines: DataFrame, hosts: DataFrame, line_docs: int, line_share: int) -> DataFrame:
    """(host, line) held by more different documents of the host than both limits allow; ``hosts``: as ``hosts_of``."""
    seen = lines.filter("line is not null").select("host", "line", "sketch").distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    seen = seen.filter(F.col("n") > line_docs)
    return seen.join(hosts, seen["host"].eqNullSafe(hosts["h"])).filter(
        F.lit(1000) * F.col("n") > F.lit(line_share) * F.col("docs")).select("host", "line")


def depleted(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: int = LINE_SHARE,
             left_share: int = LEFT_SHARE) -> DataFrame:
    """(host, tx, chars, gone) of texts that lose lines; depleted: 100 * (chars - gone) < left_share * chars.  Both sums
    take a text as often as the host holds it, which their ratio doesn't see."""
    lines = C.stored(lines_of(docs, host), "lines")
    often = C.stored(frequent_lines(lines, hosts_of(lines), line_docs, line_share), "frequent")
    hit = lines.join(often.withColumnRenamed("host", "h").withColumnRenamed("line", "l"),
                     (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")))
    gone = C.stored(hit.groupBy("host", "tx").agg(F.sum("chars").alias("gone")), "losing")
    whole = lines.join(gone.select("tx").distinct(), "tx", "left_semi").groupBy("host", "tx").agg(F.sum("chars").alias("chars"))
    gone = gone.select(F.col("host").alias("h"), F.col("tx").alias("t"), "gone")
    both = whole.join(gone, (F.col("tx") == F.col("t")) & F.col("host").eqNullSafe(F.col("h"))).drop("h", "t")
    bad = both.filter(F.lit(100) * (F.col("chars") - F.col("gone")) < F.lit(left_share) * F.col("chars"))
    return C.stored(bad, "depleted")


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, tx (the text's hash), the figures, base_failed and kept of every row."""
    bad = depleted(docs, host).select(F.col("host").alias("h"), F.col("tx").alias("t"))
    out = rule_figures(docs.select("doc_id", F.col(host).alias("host"), "text", F.xxhash64("text").alias("tx"))).drop("text")
    out = out.withColumn("base_failed", base_failed())
    out = out.join(bad, (F.col("tx") == F.col("t")) & F.col("host").eqNullSafe(F.col("h")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("t").isNull()).drop("h", "t")


def without_frequent_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """The lines that stay of every document: (host, tx, line, chars, sketch) not over the limits."""
    lines = C.stored(lines_of(docs, host), "lines")
    often = C.stored(frequent_lines(lines, hosts_of(lines), LINE_DOCS, LINE_SHARE), "frequent")
    often = often.withColumnRenamed("host", "h").withColumnRenamed("line", "l")
    return lines.filter("line is not null").join(often, (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")), "left_anti")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows that are kept, with all their columns."""
    bad = C.stored(judged(docs, host).filter("not kept").select("host", "tx").distinct(), "rejected")
    h, t = C.fresh(docs, "h"), C.fresh(docs, "t")
    bad = bad.select(F.col("host").alias(h), F.col("tx").alias(t))
    return docs.join(bad, (F.xxhash64(docs["text"]) == F.col(t)) & docs[host].eqNullSafe(F.col(h)), "left_anti")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).drop("host", "tx")


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 7), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(p, p + 8)) AS pos FROM again))
  GROUP BY doc_id),
raw AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (SELECT doc_id, source, p, trim(regexp_replace(regexp_replace(lower(line), '[1-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS x
  FROM raw),
ln AS (SELECT doc_id, source, length(x) AS chars, CAST('0x' || substr(md5(x), 1, 15) AS BIGINT) AS line, p FROM norm WHERE x <> ''),
sk AS (SELECT d.doc_id, d.source, md5(coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY p), '')) AS sketch
  FROM d LEFT JOIN ln USING (doc_id) GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT sketch) AS docs FROM sk GROUP BY source),
often AS (SELECT s.source, line FROM (SELECT ln.source, line, count(DISTINCT sketch) AS n FROM ln JOIN sk USING (doc_id) GROUP BY ALL) s
  JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source WHERE n > {LINE_DOCS} AND 1000 * n > {LINE_SHARE} * docs),
bad AS (SELECT doc_id FROM (SELECT ln.doc_id, sum(chars) AS chars,
    coalesce(sum(chars) FILTER (WHERE o.line IS NOT NULL), 0) AS gone
  FROM ln LEFT JOIN often o ON o.line = ln.line AND o.source IS NOT DISTINCT FROM ln.source GROUP BY ln.doc_id)
  WHERE gone > 0 AND 100 * (chars - gone) < {LEFT_SHARE} * chars),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT f.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND bad.doc_id IS NULL AS kept
FROM f LEFT JOIN bad ON bad.doc_id = f.doc_id
"""
