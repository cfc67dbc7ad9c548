"""Secret scans: fixed patterns, and random-looking strings by two character Markov models.

One bigram model is trained on random strings, one on ordinary identifiers; both from labelled samples of
bounded size. A string is reported when its log-likelihood ratio exceeds ``THRESHOLD``. Both models together
are one table of a weight per pair of character classes (at most 66 x 66), which is a literal in the plan:
scanning is one pass without join or shuffle. Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import let, running_total, words

# The base kinds, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"
LIMIT = len(ALPHABET)  # index of a string's start
MIN_RANDOM = 16  # shorter strings hold too little evidence
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}"
SAMPLE_ROWS = 20_000  # about so many documents (by hash) give labelled strings; bounds the training only
THRESHOLD = 14.0  # natural log: about a million to one


def _spans(text: Column, regex: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans (start, kind, end) of the leftmost non-overlapping matches; ``keep`` judges match or group text.

    Splitting at the matches gives the lengths between them, so positions are running totals.
    """
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def located(m):
        gaps = F.slice(F.transform(F.split(text, regex, -1), lambda p: F.length(p).cast("long")), F.lit(1), F.size(m["all"]))
        steps = F.zip_with(gaps, m["all"], lambda g, x: g + F.length(x))
        ends = F.zip_with(m["all"], running_total(steps), lambda x, e: F.struct(x.alias("m"), e.alias("e")))
        rows = F.zip_with(ends, m["part"], lambda a, p: F.struct(a["m"].alias("m"), a["e"].alias("e"), p.alias("p")))
        good = F.filter(rows, lambda r: keep(r["p"])) if keep is not None else rows
        return F.transform(
            good,
            lambda r: F.struct((r["e"] - F.length(r["m"])).alias("start"), F.lit(kind).alias("kind"), r["e"].alias("end")),
        )

    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    part = found if group == 0 else F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    return F.when(
        F.regexp_like(text, F.lit(regex)), let(F.struct(found.alias("all"), part.alias("part")), located)
    ).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans as array of (start, kind, end)."""
    return F.concat(
        _spans(text, ASSIGN, 0, lambda p: F.length(p) >= MIN_ASSIGN, group=2),
        # A run that is too short stays so from any later start within it, so the bound can stand in the pattern.
        _spans(text, f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", 1),
        _spans(text, f"[0-9a-f]{{{MIN_HEX},}}", 2),
    )


def _symbols(s: Column) -> Column:
    """Indexes of a string's characters in the alphabet, after the start symbol."""
    return F.concat(
        F.array(F.lit(LIMIT)),
        F.transform(F.split(s, "", -1), lambda c: F.instr(F.lit(ALPHABET), c) - 1),
    )


def labelled_strings(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(s, random) for training: ordinary identifiers out of texts, random strings out of hashes of ids.

    About ``sample_rows`` documents are taken, by a hash of id and text below a bound, so no text is moved to
    choose them. Ordinary: their words made of ASCII letters, digits and joining signs, and compounds of
    neighbouring words as identifiers have them; words inside base spans do not count. Random: hexadecimal,
    base 64 and upper-case alphanumeric digests.
    """
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    share = sample_rows / max(docs.count(), sample_rows, 1)
    draw = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    chosen = hashed.where(draw < share).dropDuplicates(["h"])
    clean = F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), f"AKIA[A-Z0-9]+|[0-9a-f]{{{MIN_HEX},}}", " ")
    plain = F.filter(words(F.regexp_replace(clean, "[.,;:!?]+", " ")), lambda w: F.regexp_like(w, F.lit("^[A-Za-z0-9+/_=-]{2,40}$")))
    signs = ["", "_", "-", "/"]
    compounds = let(
        plain,
        lambda ws: F.transform(
            ws, lambda w, i: F.concat(w, F.element_at(F.array(*[F.lit(x) for x in signs]), i % len(signs) + 1), F.coalesce(F.get(ws, i + 1), F.lit("")))
        ),
    )
    ordinary = chosen.select(F.explode(compounds).alias("s")).select("s", F.lit(False).alias("random"))
    digest = F.unhex(F.sha2(F.col("h").cast("string"), 256))
    kinds = F.array(
        F.sha2(F.concat(F.lit("hex"), F.col("h").cast("string")), 256),
        F.regexp_replace(F.base64(digest), "\\s", ""),
        F.regexp_replace(F.upper(F.base64(F.unhex(F.sha2(F.concat(F.lit("up"), F.col("h").cast("string")), 256)))), "[^A-Z0-9]", ""),
    )
    random = chosen.select(F.explode(kinds).alias("s")).select("s", F.lit(True).alias("random"))
    return ordinary.unionByName(random)


def train_weights(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio per pair of symbols, add-one smoothed: random over ordinary, row by first symbol.

    The table has a fixed size (66 x 65), whatever the sample.
    """
    seen = labelled.where(F.length("s") > 0).withColumn("x", _symbols(F.col("s")))
    pairs = seen.select(
        "random",
        F.explode(
            let(F.col("x"), lambda x: F.transform(
                F.sequence(F.lit(1), F.size(x) - 1),
                lambda i: F.struct(F.get(x, i - 1).alias("a"), F.get(x, i).alias("b")),
            ))
        ).alias("p"),
    ).where("p.a >= 0 AND p.b >= 0")
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("random", "p.a", "p.b").agg(F.count("*").alias("n")).collect()}
    table = []
    for a in range(LIMIT + 1):
        totals = {k: sum(counts.get((k, a, b), 0) + 1 for b in range(LIMIT)) for k in (True, False)}
        table += [
            math.log((counts.get((True, a, b), 0) + 1) / totals[True]) - math.log((counts.get((False, a, b), 0) + 1) / totals[False])
            for b in range(LIMIT)
        ]
    return table


def score(s: Column, weights: list[float]) -> Column:
    """Log-likelihood ratio of a string of the alphabet's characters."""
    table = F.array(*[F.lit(round(w, 6)) for w in weights])
    return let(
        F.struct(_symbols(s).alias("x"), table.alias("t")),
        lambda v: F.aggregate(
            F.sequence(F.lit(1), F.size(v["x"]) - 1),
            F.lit(0.0),
            lambda acc, i: acc + F.get(v["t"], F.get(v["x"], i - 1) * LIMIT + F.get(v["x"], i)),
        ),
    )


def random_spans(text: Column, weights: list[float], threshold: float = THRESHOLD) -> Column:
    return _spans(text, CANDIDATE, 3, lambda s: score(s, weights) >= threshold)


def find_secrets(docs: DataFrame, weights: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs``: doc_id, base and spans, arrays of (start, kind, end) ordered by start, then kind.

    Positions are code points, ends exclusive. ``spans`` holds the base spans and, of the strings the models
    find, those that overlap no base span. Null text counts as empty; no match gives empty arrays; repeated
    rows are answered each; other columns are ignored.
    """
    weights = train_weights(labelled_strings(docs)) if weights is None else weights
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.sort_array(base_spans(text)).alias("base"), random_spans(text, weights, threshold).alias("more"))
    fresh = F.filter(
        "more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    )
    return found.select("doc_id", "base", F.sort_array(F.concat("base", fresh)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_spans(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
