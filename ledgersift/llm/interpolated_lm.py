"""Language-model scores by deleted interpolation (Jelinek and Mercer 1980).

The training documents give n-gram counts. A fixed tenth of them is deleted from the counts to learn how far
maximum-likelihood estimates of each order can be trusted: contexts fall into buckets (the longest context that
was seen, and its frequency by powers of two), and every bucket gets its mixture of the orders and of a uniform
share for unseen words, by expectation-maximisation on the deleted tenth. Documents are then scored with the
counts of all training documents.

Texts are cut into slices of a few megabytes, each of one kind (scored only, deleted tenth, counted), and kept as
word numbers. A slice sends every distinct n-gram it holds once, as a 64-bit key with its count, to the bucket of
keys it falls into; the bucket adds the counts up and answers each slice in the order it was asked. So a word that
fills a third of all texts costs one key a slice, nothing is broadcast but the mixtures (at most 64 buckets an
order), and no task holds more than a slice or a bucket, whose number follows the number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.cluster import stored

ORDER = 2
FOLDS = 10
HELD_OUT, DELETED, COUNTED = 0, 1, 2  # kinds of slices: fold 0, fold 1, the others
SLICE_BYTES = 3 << 20  # text of a slice; a longer text is a slice by itself
TEXTS = 3_000  # texts that come to a task at once
BUCKET_TOKENS = 1 << 20  # tokens by which the number of key buckets follows the corpus
SEED = 42
END = b" "  # no word; closes every text, and stands before its first word
FREQUENCIES = 64  # context buckets of an order: by powers of two
ROUNDS, GAIN = 40, 1e-5  # expectation-maximisation ends when a token gains less than GAIN nats
PRIOR = 2.0  # tokens' worth of the mixture over all buckets, in each bucket


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, the lowest first, without those that are zero in all of them."""
    size = values.itemsize
    top = int(values.view(f"u{size}").max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(len(values), size)[:, :width].T).tobytes()


def unpacked(data: bytes, kind) -> np.ndarray:
    kind, width = np.dtype(kind), data[0]
    n = (len(data) - 1) // width
    wide = np.zeros((n, kind.itemsize), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, n).T
    return wide.reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as gaps."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for what runs inside: a batch of texts or slices is held whole on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _slices(id_type: pa.DataType):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            ids = batch.column("doc_id")
            texts = batch.column("text").cast(pa.binary())
            sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for kind in np.unique(kinds):
                at = np.flatnonzero(kinds == kind)
                part = np.cumsum(sizes[at]) // SLICE_BYTES
                for rows in np.split(at, np.flatnonzero(np.diff(part)) + 1):
                    yield _slice(number, int(kind), ids.take(pa.array(rows)), texts.take(pa.array(rows)).to_pylist(), id_type)
                    number += 1

    return cut


def _slice(number: int, kind: int, ids: pa.Array, texts: list, id_type: pa.DataType) -> pa.RecordBatch:
    """A slice of texts as word numbers, in the order of the words' keys."""
    tokens, lens = [], []
    for text in texts:
        # bytes.lower and bytes.split know ASCII letters and the six ASCII space characters only.
        words = (text or b"").lower().split()
        tokens += words
        tokens.append(END)
        lens.append(len(words) + 1)
    distinct = list(set(tokens))
    keys = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in distinct), np.uint64, len(distinct))
    keys, place = np.unique(keys, return_inverse=True)
    codes = dict(zip(distinct, place.tolist()))
    codes = np.fromiter(map(codes.__getitem__, tokens), np.int32, len(tokens))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number]), pa.array([kind], pa.int32()), pa.array([ids.to_pylist()], pa.list_(id_type)),
            pa.array([lens], pa.list_(pa.int32())), pa.array([packed_keys(keys)], pa.binary()), pa.array([packed(codes)], pa.binary()),
        ],
        names=["slice", "kind", "ids", "lens", "words", "codes"],
    )


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of an n-gram from that of its beginning and its last word's."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def grams(words: np.ndarray, codes: np.ndarray, lens: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order: distinct keys in ascending order, and each token's place among them.

    The n-gram of a token ends with it; before a text's first word stands its end mark, again and again.
    """
    end = np.uint64(xxhash.xxh64_intdigest(END, SEED))
    first = np.cumsum(lens) - lens
    own, key, found = words[codes], words[codes], [(words, codes)]
    before = end
    for _ in range(2, order + 1):
        shifted = np.empty_like(key)
        shifted[1:] = key[:-1]
        shifted[first] = before
        # An n-gram of end marks alone is the context of a first word.
        before = _mixed(np.array([before]), np.array([end]))[0]
        key = _mixed(shifted, own)
        found.append(np.unique(key, return_inverse=True))
    return found


def _held(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpacked_keys(row["words"]), unpacked(row["codes"], np.int32), np.array(row["lens"], np.int64)


def _asked(order: int, bits: int):
    """(part, slice, kind, words, keys, counts): the n-grams of a slice, by order and leading bits of the key."""
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                words, codes, lens = _held(row)
                out = []
                for n, (keys, place) in enumerate(grams(words, codes, lens, order)):
                    counts = np.bincount(place, minlength=len(keys)).astype(np.uint32)
                    ends = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    out += [
                        ((n << bits) + b, n == 0, packed_keys(keys[x:y]), packed(counts[x:y]))
                        for b, (x, y) in enumerate(zip(ends, ends[1:])) if y > x
                    ]
                part, single, keys, counts = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, pa.int64()), pa.array([row["slice"]] * len(out)), pa.array([row["kind"]] * len(out), pa.int32()),
                        pa.array(single), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()),
                    ],
                    names=["part", "slice", "kind", "words", "keys", "counts"],
                )

    return ask


ASKED = "part long, slice long, kind int, words boolean, keys binary, counts binary"
ANSWERED = "part long, slice long, kind int, every binary, counted binary, tokens long, known long, tokens_counted long, known_counted long"


def _answers(table: pa.Table) -> pa.Table:
    """Counts of all keys of a part, per slice as asked; a row without slice has the sums over words."""
    part, kinds = table["part"][0].as_py(), table["kind"].to_pylist()
    keys = [unpacked_keys(x.as_py()) for x in table["keys"]]
    counts = np.concatenate([unpacked(x.as_py(), np.uint32) for x in table["counts"]]).astype(np.float64)
    sizes = np.array([len(x) for x in keys])
    kind = np.repeat(np.array(kinds), sizes)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    # Sums of whole numbers, exact up to 2^53.
    counted, deleted = (
        np.bincount(place, weights=counts * (kind == k), minlength=len(distinct)).astype(np.int64) for k in (COUNTED, DELETED)
    )
    every = counted + deleted
    ends = [0, *np.cumsum(sizes).tolist()]
    at = list(zip(ends, ends[1:]))
    single = table["words"][0].as_py()
    n = len(kinds)
    figures = [every.sum(), (every > 0).sum(), counted.sum(), (counted > 0).sum()] if single else [0] * 4
    return pa.table(
        [
            pa.array([part] * (n + 1)), pa.array([*table["slice"].to_pylist(), None], pa.int64()), pa.array([*kinds, None], pa.int32()),
            pa.array([*(packed(every[place[x:y]]) for x, y in at), None], pa.binary()),
            pa.array([*(packed(counted[place[x:y]]) if k == DELETED else None for k, (x, y) in zip(kinds, at)), None], pa.binary()),
            *(pa.array([None] * n + [int(v)], pa.int64()) for v in figures),
        ],
        names=[f.split()[0] for f in ANSWERED.split(", ")],
    )


def token_counts(row: dict, answers: pa.Table, column: str, order: int, bits: int, texts: int):
    """Per order, for every token: the count of its n-gram and of that n-gram's context; and the lengths of the texts."""
    words, codes, lens = _held(row)
    found = {p: unpacked(x, np.int64) for p, x in zip(answers["part"].to_pylist(), answers[column].to_pylist())}
    first = np.cumsum(lens) - lens
    gram, context, below = [], [], None
    for n, (keys, place) in enumerate(grams(words, codes, lens, order)):
        counts = np.concatenate([found[p] for p in range(n << bits, (n + 1) << bits) if p in found])[place]
        if len(counts) != len(codes) or len(keys) != sum(len(found[p]) for p in range(n << bits, (n + 1) << bits) if p in found):
            raise RuntimeError("a slice was answered for other n-grams than it holds")
        if below is not None:
            before = np.empty_like(below)
            before[1:] = below[:-1]
            before[first] = texts  # marks before a first word: as often as there are texts
            context.append(before)
        gram.append(counts)
        below = counts
    return gram, context, lens


def context_bucket(context: list[np.ndarray], size: int) -> np.ndarray:
    """0: no context was seen; else the longest seen one and the power of two of its frequency."""
    bucket = np.zeros(size, np.int32)
    for n, counts in enumerate(context):
        seen = counts > 0
        bucket[seen] = n * FREQUENCIES + np.frexp(counts[seen].astype(np.float64))[1]
    return bucket


def estimates(gram: list[np.ndarray], context: list[np.ndarray], tokens: int, known: int) -> list[np.ndarray]:
    """Maximum-likelihood estimates: uniform, single words, then by longer contexts; 0 where the context was not seen."""
    single = gram[0] / tokens if tokens else np.zeros(len(gram[0]))
    uniform = np.full(len(single), 1.0 / (known + 1))
    return [uniform, single, *(g / np.maximum(c, 1) for g, c in zip(gram[1:], context))]


def _usable(bucket: int, order: int) -> np.ndarray:
    """Estimates that a bucket can mix: up to its longest seen context."""
    top = 1 if bucket == 0 else 2 + (bucket - 1) // FREQUENCIES
    return np.arange(order + 1) <= top


def mixtures(deleted: DataFrame, order: int) -> np.ndarray:
    """Weights by bucket (rows) and estimate (columns), from rows of (bucket, p0, p1, ...) with one row a token."""
    buckets = 1 + max(1, order - 1) * FREQUENCIES
    usable = np.array([_usable(b, order) for b in range(buckets)])
    weights = usable / usable.sum(axis=1, keepdims=True)
    names = [f"p{k}" for k in range(order + 1)]
    last = None
    for _ in range(ROUNDS):
        table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights])
        shares = deleted.withColumn("w", F.element_at(table, F.col("bucket") + 1))
        parts = [F.get("w", F.lit(k)) * F.col(p) for k, p in enumerate(names)]
        total = sum(parts[1:], parts[0])
        sums = shares.select("bucket", F.log(total).alias("gain"), *[(p / total).alias(n) for p, n in zip(parts, names)])
        sums = sums.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("gain").alias("gain"), *[F.sum(n).alias(n) for n in names])
        found = sums.collect()  # one row a bucket
        if not found:
            return weights
        got = np.zeros((buckets, order + 1))
        for r in found:
            got[r["bucket"]] = [r[n] for n in names]
        overall = (got.sum(axis=0) + 1) * usable
        overall /= overall.sum(axis=1, keepdims=True)
        weights = got + PRIOR * overall
        weights /= weights.sum(axis=1, keepdims=True)
        now = sum(r["gain"] for r in found) / sum(r["n"] for r in found)
        if last is not None and now - last < GAIN:
            break
        last = now
    return weights


def interpolated_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end mark alone; texts are taken whole, words by ASCII spaces with A-Z lower-cased.
    Fold 0 of a doc_id's checksum is held out, fold 1 the deleted tenth. A null doc_id is scored, never learned
    from, and has a null held_out. Repeated rows count and are answered each; other columns are ignored; an empty
    table gives an empty result. Without training tokens the base score of a token is 0 and the uniform estimate
    1; without a deleted tenth every bucket mixes its estimates evenly.
    """
    spark = docs.sparkSession
    number = fold(F.col("doc_id"))
    kind = F.when(number == 0, HELD_OUT).when(number == 1, DELETED).when(number > 1, COUNTED).otherwise(HELD_OUT).cast("int")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), kind.alias("kind"))
    id_type = rows.schema["doc_id"].dataType
    arrow_type = rows.select("doc_id").limit(0).toArrow().schema[0].type
    schema = f"slice long, kind int, ids array<{id_type.simpleString()}>, lens array<int>, words binary, codes binary"
    with batches_of(spark, TEXTS):
        slices = stored(rows.mapInArrow(_slices(arrow_type), schema), "slices")
    size = F.aggregate("lens", F.lit(0).cast("long"), lambda s, n: s + n)
    tokens, texts, texts_counted = slices.agg(
        F.sum(size), F.sum(F.when(F.col("kind") > 0, F.size("lens"))), F.sum(F.when(F.col("kind") == COUNTED, F.size("lens")))
    ).first()
    bits = max(0, int(np.ceil(np.log2(max(1, (tokens or 0) / BUCKET_TOKENS)))))
    with batches_of(spark, 4):
        asked = slices.mapInArrow(_asked(order, bits), ASKED)
        answers = stored(asked.groupBy("part").applyInArrow(_answers, ANSWERED), "answers")
    names = ("tokens", "known", "tokens_counted", "known_counted")
    n, known, n_counted, known_counted = (x or 0 for x in answers.where("slice IS NULL").agg(*[F.sum(x) for x in names]).first())
    texts, texts_counted = texts or 0, texts_counted or 0

    def deleted_tokens(held: pa.Table, answered: pa.Table) -> pa.Table:
        gram, context, _ = token_counts(held.to_pylist()[0], answered, "counted", order, bits, texts_counted)
        columns = {"bucket": context_bucket(context, len(gram[0]))}
        return pa.table(columns | {f"p{k}": p for k, p in enumerate(estimates(gram, context, n_counted, known_counted))})

    def joined(kinds: str):
        a, b = slices.where(kinds), answers.where("slice IS NOT NULL").where(kinds)
        return a.groupBy("slice").cogroup(b.select("slice", "part", "every", "counted").groupBy("slice"))

    columns = ", ".join(f"p{k} double" for k in range(order + 1))
    deleted = stored(joined(f"kind = {DELETED}").applyInArrow(deleted_tokens, f"bucket int, {columns}"), "deleted-tokens")
    weights = mixtures(deleted, order)

    def scored(held: pa.Table, answered: pa.Table) -> pa.Table:
        gram, context, lens = token_counts(held.to_pylist()[0], answered, "every", order, bits, texts)
        weight = weights[context_bucket(context, len(gram[0]))]
        chance = sum(weight[:, k] * p for k, p in enumerate(estimates(gram, context, n, known)))
        first = np.cumsum(lens) - lens
        base = np.log10((gram[0] + 0.1) / (n + 0.1 * (known + 1)))
        return pa.table({
            "doc_id": held["ids"].combine_chunks().flatten(), "n_tokens": lens,
            "n_known": np.add.reduceat((gram[0] > 0).astype(np.int64), first),
            "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(chance), first),
        })

    result = joined("true").applyInArrow(
        scored, f"doc_id {id_type.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    )
    return result.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def lm_scores(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document."""
    return interpolated_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
