"""Line dedup by a fixed-depth template tree (after Drain, He et al. 2017), in DataFrame expressions.

Runs of digits are variable fields. A line's place in the tree is its token count and its ``DEPTH`` leading
tokens; the whole line is kept as up to ``BANDS`` hashes of consecutive token ranges. Within a leaf lines come
in order of frequency (of equally frequent ones the first comes first): a line that agrees with an earlier
template in at least ``AGREE`` of the bands belongs to the earliest such template, and the bands that differ
are its variable fields; any other line is a template itself. A leaf has as many templates as that gives. A
template that at least ``MIN_DOCS`` documents hold recurs: its first line, by doc_id and place, stays and all
others are dropped.

Lines that agree meet by equality: under a key made of all bands but those that may differ. In one round all
open lines that come first under each of their keys become templates and close every line they meet, which
gives what taking the lines one by one gives (the first maximal independent set, Blelloch et al. 2012).

Only hashes are shuffled to find templates; counts are combined before each shuffle, so a line found in a
third of all documents is a few rows per task. Texts move once, to the documents' dropped line numbers.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.cluster import stored

from .expressions import SPACE, let

DEPTH = 4
BANDS = 8
AGREE = 0.75
ROUNDS = 2  # templates per leaf that the SQL counterpart generalises; the operator has no such bound
MIN_DOCS = 3
MIN_TOKENS = 4  # shorter lines coincide by chance and are never templates

B = [f"b{i}" for i in range(BANDS)]
PLACE = ["doc_id", "text_hash", "line_no"]


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, SPACE, -1), lambda t: t != "")


def _parsed(tokens: Column) -> Column:
    """(n, leaf, b0..): token count, tree leaf, band hashes; a line of fewer tokens has as many bands as tokens."""
    n = F.size(tokens)
    leaf = F.xxhash64(n, *[F.get(tokens, F.lit(i)) for i in range(DEPTH)])

    def band(k):
        low, high = F.call_function("div", n * k, F.lit(BANDS)), F.call_function("div", n * (k + 1), F.lit(BANDS))
        return F.hash(F.slice(tokens, (low + 1).cast("int"), (high - low).cast("int")))

    return F.struct(n.alias("n"), leaf.alias("leaf"), *[band(k).alias(B[k]) for k in range(BANDS)])


def parse_lines(docs: DataFrame) -> DataFrame:
    """One row per line that can be a template: doc_id, text_hash, line_no (from 0), n, leaf, b0.. ."""
    masked = F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9]+", "<*>")
    lines = F.transform(F.split(masked, "\n", -1), lambda x: let(_tokens(x), _parsed))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines).alias("line_no", "l"))
    return rows.select("doc_id", "text_hash", "line_no", "l.*").where(F.col("n") >= MIN_TOKENS)


def _agreeing(lines: DataFrame) -> DataFrame:
    """(own, rank, key): lines that agree in enough bands share a key; keys of one line are left out."""
    gone = BANDS - math.ceil(AGREE * BANDS)
    # Of gone + 1 groups of bands one agrees as a whole, so a line alone in all its groups agrees with none.
    groups = [F.xxhash64("leaf", F.lit(g), *B[g :: gone + 1]) for g in range(gone + 1)]
    few = lines.select("own", F.explode(F.array(*groups)).alias("group"))
    met = few.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    some = few.join(met, "group").select("own").distinct()
    kept = [[b for k, b in enumerate(B) if k not in out] for out in itertools.combinations(range(BANDS), gone)]
    keys = F.array(*[F.xxhash64("leaf", F.lit(i), *bands) for i, bands in enumerate(kept)])
    rank = F.struct((-F.col("rows")).alias("rows"), "first", "own").alias("rank")
    spread = stored(lines.join(some, "own").select("own", rank, F.explode(keys).alias("key")), "line-keys")
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return stored(spread.join(shared, "key").select("own", "rank", "key"), "shared-line-keys")


def _templates(lines: DataFrame) -> DataFrame:
    """(leaf, b0.., template, rows): the template of every distinct line."""
    distinct = stored(
        lines.groupBy("n", "leaf", *B).agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(*PLACE)).alias("first"))
        .withColumn("own", F.xxhash64("n", "leaf", *B)), "lines"
    )
    # Only leaves with several distinct lines have anything to merge.
    several = distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf")
    keys = _agreeing(distinct.join(several, "leaf"))
    left, leaders = keys, None
    while not left.isEmpty():
        least = stored(left.groupBy("key").agg(F.min("rank").alias("least")), "least")
        judged = left.join(least, "key").groupBy("own").agg(F.bool_and(F.col("own") == F.col("least.own")).alias("leads"))
        new = stored(judged.where("leads").select("own"), "leaders")
        leaders = new if leaders is None else leaders.unionAll(new)
        taken = least.select("key", F.col("least.own").alias("own")).join(new, "own").select("key")
        closed = left.join(taken, "key").select("own").distinct()
        left = stored(left.join(closed, "own", "left_anti"), "open-lines")
    if leaders is None:
        return distinct.select("leaf", *B, F.col("own").alias("template"), "rows")
    led = keys.join(leaders, "own").groupBy("key").agg(F.min("rank").alias("top"))
    found = keys.join(led, "key").groupBy("own").agg(F.min("top").alias("top"))
    found = found.select("own", F.col("top.own").alias("template"))
    joined = distinct.join(found, "own", "left")
    return stored(joined.select("leaf", *B, F.coalesce("template", "own").alias("template"), "rows"), "templates")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, dropped): sorted line numbers, for documents that lose lines."""
    lines = stored(parse_lines(docs), "parsed-lines")
    members = _templates(lines)
    often = members.groupBy("template").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= min_docs)
    recurring = stored(members.join(often.select("template"), "template").select("leaf", *B, "template"), "recurring")
    hits = stored(lines.join(recurring, ["leaf", *B]).select(*PLACE, "template"), "hits")
    # Rows of one document for one template come together first, so documents are counted without a hot task.
    per_doc = hits.groupBy("template", "doc_id", "text_hash").agg(F.min("line_no").alias("line_no"))
    kept = per_doc.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct(*PLACE)).alias("first"))
    drop = hits.join(kept.where(F.col("docs") >= min_docs), "template").where(~F.struct(*PLACE).eqNullSafe(F.col("first")))
    return drop.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def _without(lines: Column, dropped: Column) -> Column:
    """Lines between the dropped ones, whose numbers are sorted."""
    def between(d):
        def part(i):
            low = F.when(i == 0, F.lit(0)).otherwise(F.get(d, F.greatest(i - 1, F.lit(0))) + 1)
            high = F.coalesce(F.get(d, i), F.size(lines))
            return F.slice(lines, low + 1, high - low)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(d)), part))

    return let(dropped, between)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` with recurring lines cut out of ``text``, plus __n_lines and __dropped (line numbers).

    Every row stays, with an empty text if all its lines go; a null text stays null. Rows that agree in doc_id
    and text are one document; rows with a null doc_id are told apart by text. Where two rows could be first,
    the smaller doc_id (null first) and text hash wins. Other columns pass through; an empty table gives an
    empty result.
    """
    names = docs.columns
    dropped = dropped_lines(docs.select("doc_id", "text"), min_docs)
    dropped = dropped.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), F.col("dropped").alias("__dropped"))
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64("text").alias("__th"))
    met = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")), "left")
    cut = F.array_join(let(F.split("text", "\n", -1), lambda ls: _without(ls, F.col("__dropped"))), "\n")
    out = [F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else F.col(f"`{c}`") for c in names]
    return met.select(
        *out, F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("__n_lines"),
        F.coalesce("__dropped", F.array().cast("array<int>")).alias("__dropped"),
    )


def line_dedup(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.size("__dropped").cast("long").alias("n_dropped"),
        F.array_join(F.col("__dropped").cast("array<string>"), ",").alias("dropped_lines"),
        F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"),
    )


def _sql() -> str:
    """The same on token lists instead of hashes, for up to ``ROUNDS`` templates per leaf; doc_id is unique in ``documents``."""
    bands = ", ".join(f"list_slice(t, (len(t) * {k}) // {BANDS} + 1, (len(t) * {k + 1}) // {BANDS}) AS {B[k]}" for k in range(BANDS))
    names = ", ".join(B)
    steps, known = [], "d0"
    for r in range(ROUNDS):
        same = " + ".join(f"CAST(d.{b} = m.{b} AS INTEGER)" for b in B)
        steps.append(f"""
m{r} AS (SELECT * FROM (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY n, leaf) AS lines
  FROM {known} WHERE template IS NULL WINDOW w AS (PARTITION BY n, leaf ORDER BY n_rows DESC, first)) WHERE place = 1 AND lines > 1),
d{r + 1} AS (SELECT d.* REPLACE (coalesce(d.template, CASE WHEN {same} >= {AGREE * BANDS} THEN m.line END) AS template)
  FROM {known} d LEFT JOIN m{r} m ON d.n = m.n AND d.leaf = m.leaf)""")
        known = f"d{r + 1}"
    return f"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
numbered AS (SELECT doc_id, unnest(ls) AS raw_line, generate_subscripts(ls, 1) - 1 AS line_no FROM raw),
parsed AS (SELECT doc_id, line_no, list_filter(string_split_regex(regexp_replace(raw_line, '[0-9]+', '<*>', 'g'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t
  FROM numbered),
cut AS (SELECT doc_id, line_no, t AS line, len(t) AS n, list_slice(t, 1, {DEPTH}) AS leaf, {bands} FROM parsed WHERE len(t) >= {MIN_TOKENS}),
d0 AS (SELECT line, n, leaf, {names}, count(*) AS n_rows, min((doc_id, line_no)) AS first, CAST(NULL AS VARCHAR[]) AS template
  FROM cut GROUP BY line, n, leaf, {names}),{','.join(steps)},
hits AS (SELECT doc_id, line_no, coalesce(template, line) AS template FROM cut JOIN {known} USING (line)),
kept AS (SELECT template, count(DISTINCT doc_id) AS docs, min((doc_id, line_no)) AS first FROM hits GROUP BY template),
dropped AS (SELECT doc_id, list(DISTINCT line_no ORDER BY line_no) AS gone FROM hits JOIN kept USING (template)
  WHERE docs >= {MIN_DOCS} AND (doc_id, line_no) <> first GROUP BY doc_id),
texts AS (SELECT doc_id, len(ls) AS n_lines, coalesce(gone, []) AS gone,
  array_to_string(list_filter(ls, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), chr(10)) AS kept FROM raw LEFT JOIN dropped USING (doc_id))
SELECT doc_id, n_lines, CAST(len(gone) AS BIGINT) AS n_dropped, array_to_string(gone, ',') AS dropped_lines,
  length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM texts
"""


LINE_SQL = _sql()
