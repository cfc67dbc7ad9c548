"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts becomes its distinct units: a unit is a word with the space mark before it, and no piece
reaches beyond one. The units of a batch are concatenated and indexed by a suffix array (suffixes are ordered
by as many characters as the longest piece has). Every piece is binary-searched for its range of occurrences;
the ranges give edges (start, end, piece), which are sorted by position and relaxed from left to right.

The model is a byte-pair encoding, so the best path is not the one of largest score. An edge is taken if it is
compatible with the piece before it: two neighbouring pieces must be what the merges make of their joint text.
Exactly one edge into each position is compatible, and these edges are the encoding. (A path is the result of
the merges if and only if its neighbours are compatible, because no merge reaches across a boundary that holds
for both sides.) Runs of space marks, whose pieces all have one score, and units where no single edge fits are
merged directly.

Characters that no piece holds become bytes. The model is read by the driver and travels with the task.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
TEXTS = 1_000  # texts indexed together
CACHE = 1_000_000  # encoded units a worker remembers; only speeds repetition
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # fixed values of the model format


def load_model(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or rules.precompiled_charsmap:
        raise ValueError("expected a byte-pair model with byte fallback and no normalisation table")
    if not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("expected a model that keeps all spaces and puts one in front")
    if any(p.type == USER or MARK in p.piece.strip(MARK) for p in model.pieces):
        raise ValueError("pieces that reach over a space or are set by the user are not supported")
    return [(p.piece, p.score, p.type) for p in model.pieces]


class Encoder:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.text = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [byte_of.get(i, p.encode("utf-8")) for i, p in enumerate(self.text)]
        self.unknown = len(pieces)  # stands for any character that no piece holds
        self.longest = max(map(len, self.ids))
        chars = sorted({c for p in self.ids for c in p})
        self.known = set(chars)
        self.code = {c: i + 2 for i, c in enumerate(chars)}  # 0: end of unit, 1: unknown character
        self.table = np.ones(0x110000, dtype=">u2")
        self.table[[ord(c) for c in chars]] = [self.code[c] for c in chars]
        order = sorted(self.ids, key=lambda p: [self.code[c] for c in p])
        width = self.longest
        low, high = np.zeros((len(order), width), ">u2"), np.full((len(order), width), 0xFFFF, ">u2")
        for k, p in enumerate(order):
            low[k, : len(p)] = high[k, : len(p)] = [self.code[c] for c in p]
        self.low, self.high = (a.view(f"S{2 * width}").ravel() for a in (low, high))
        self.piece_id = np.array([self.ids[p] for p in order], np.int64)
        self.piece_len = np.array([len(p) for p in order], np.int64)
        outside = "".join(c for c in "\n\t\r" if c not in self.known)
        # Runs of marks with the word that follows; words; characters that end a word anyway.
        self.unit = re.compile(f"{MARK}{{2,}}[^{MARK}{outside}]*|{MARK}?[^{MARK}{outside}]+|[{MARK}{outside}]")
        self.alone: dict[int, bool] = {}
        self.pair_keys, self.pair_values = np.empty(0, np.int64), np.empty(0, bool)
        self.cache: dict[str, bytes] = {}  # ids as 32-bit numbers

    def merged(self, s: str) -> list[str]:
        """Pieces after all merges: highest score first, then leftmost."""
        parts: list[str | None] = list(s)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (joined := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[joined], i, j, len(joined)))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, j, n = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != n:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def numbers(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for p in parts:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32).tobytes()

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Per pair of piece ids; ``unknown`` goes with everything, left -1 is the start of a unit."""
        keys = (left + 1) * (self.unknown + 1) + right
        free = (left == self.unknown) | (right == self.unknown)
        result = free.copy()
        asked, inverse = np.unique(keys[~free], return_inverse=True)
        at = np.searchsorted(self.pair_keys, asked)
        seen = np.zeros(len(asked), bool)
        inside = at < len(self.pair_keys)
        seen[inside] = self.pair_keys[at[inside]] == asked[inside]
        fresh = asked[~seen]
        if len(fresh):
            values = []
            for key in fresh.tolist():
                a, b = divmod(key, self.unknown + 1)
                pieces = ([self.text[a - 1]] if a else []) + [self.text[b]]
                values.append(self.merged("".join(pieces)) == pieces)
            keys2 = np.concatenate([self.pair_keys, fresh])
            order = np.argsort(keys2, kind="stable")
            self.pair_keys = keys2[order]
            self.pair_values = np.concatenate([self.pair_values, np.array(values, bool)])[order]
        if len(asked):
            result[~free] = self.pair_values[np.searchsorted(self.pair_keys, asked)][inverse]
        # The first piece of a unit after an unknown character, or a piece before one, must stand by itself.
        lone = free & (right != self.unknown) & (left == self.unknown)
        if lone.any():
            result[lone] = self._compatible(np.full(lone.sum(), -1), right[lone])
        return result

    def _edges(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence, sorted by end."""
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(points == 0, 0, self.table[points])
        width = self.longest
        padded = np.concatenate([codes, np.zeros(width, codes.dtype)]).astype(">u2")  # big-endian bytes sort as numbers
        windows = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(codes)]
        suffixes = np.ascontiguousarray(windows).view(f"S{2 * width}").ravel()
        order = np.argsort(suffixes, kind="stable")
        ordered = suffixes[order]
        first, last = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        counts = last - first
        total = counts.sum()
        rank = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        start = order[rank]
        end = start + np.repeat(self.piece_len, counts)
        piece = np.repeat(self.piece_id, counts)
        odd = np.flatnonzero(codes == 1)
        start, end = np.concatenate([start, odd]), np.concatenate([end, odd + 1])
        piece = np.concatenate([piece, np.full(len(odd), self.unknown)])
        by = np.argsort(end, kind="stable")
        return start[by], end[by], piece[by]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Encodings of distinct units."""
        if not units:
            return []
        joined = "\0".join(units) + "\0"
        lengths = np.array([len(u) for u in units])
        begins = np.cumsum(lengths + 1) - lengths - 1
        start, end, piece = self._edges(joined)
        unit_of = np.searchsorted(begins, start, "right") - 1
        depth = end - begins[unit_of]  # a piece holds no separator, so it ends inside its unit
        by = np.argsort(depth, kind="stable")
        start, end, piece, depth = start[by], end[by], piece[by], depth[by]
        steps = np.flatnonzero(np.diff(depth, prepend=0)).tolist() + [len(depth)]
        last = np.full(len(joined) + 1, -2, np.int64)  # piece that ends at a position; -1: start of a unit
        last[begins] = -1
        source = np.zeros(len(joined) + 1, np.int64)
        taken = np.zeros(len(joined) + 1, np.int64)
        for a, b in zip(steps, steps[1:]):
            left = last[start[a:b]]
            good = left != -2
            good[good] = self._compatible(left[good], piece[a:b][good])
            s, e, p = start[a:b][good], end[a:b][good], piece[a:b][good]
            last[e], source[e] = p, s
            np.add.at(taken, e, 1)
        # Walk back from all ends at once; where not exactly one edge fits, the unit is merged directly.
        at, live, steps_back = begins + lengths, np.arange(len(units)), []
        direct = np.zeros(len(units), bool)
        while len(live):
            odd = (taken[at] != 1) | (last[at] == self.unknown)
            direct[live[odd]] = True
            live, at = live[~odd], at[~odd]
            steps_back.append((live, last[at]))
            at = source[at]
            more = at > begins[live]
            live, at = live[more], at[more]
        owner = np.concatenate([o for o, _ in steps_back][::-1])
        tokens = np.concatenate([t for _, t in steps_back][::-1]).astype(np.int32)
        tokens = tokens[np.argsort(owner, kind="stable")].tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(units)))).tolist()
        return [
            self.numbers(self.merged(u)) if bad else tokens[low:high]
            for u, bad, low, high in zip(units, direct.tolist(), [0, *ends], ends)
        ]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; an empty text has none."""
        cut = [self.unit.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = sorted({u for units in cut for u in units if u not in self.cache})
        if len(self.cache) + len(fresh) > CACHE:
            self.cache.clear()
            fresh = sorted({u for units in cut for u in units})
        plain = [u for u in fresh if not u.startswith(MARK * 2) and "\0" not in u]
        self.cache.update(zip(plain, self.encode_units(plain)))
        for u in fresh:
            if u not in self.cache:
                self.cache[u] = self.numbers(self.merged(u))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, units)), np.int32) for units in cut]

    def decode(self, ids) -> str:
        """The text of ids: byte pieces as UTF-8, marks as spaces, without the space put in front."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(pieces: list[tuple[str, float, int]]) -> Encoder:
    """One encoder per worker process and model."""
    key = hash(tuple(pieces[-50:])) ^ len(pieces)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(pieces)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, model: str = MODEL, *carried: str) -> DataFrame:
    """Carried columns and ``ids`` array<int> for every row of ``docs``.

    Whole texts are encoded as the model's own library does. A null or empty text has no ids. Repeated rows are
    encoded each; an empty table gives an empty result. Nothing is shuffled.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_model(model))  # bounded by the model: half a megabyte

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(pieces.value)
        for texts in batches:
            out = []
            for i in range(0, len(texts), TEXTS):
                out += encoder.encode([t or "" for t in texts.iloc[i : i + TEXTS]])
            yield pd.Series(out, dtype=object)

    return docs.select(*[F.col(f"`{c}`") for c in carried], ids("text").alias("ids"))


def decode_documents(tokens: DataFrame, model: str = MODEL, *carried: str) -> DataFrame:
    """Carried columns and ``text`` for every row of ``tokens`` (ids); null ids give a null text."""
    pieces = tokens.sparkSession.sparkContext.broadcast(load_model(model))

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(pieces.value)
        for ids in batches:
            yield pd.Series([None if x is None else encoder.decode(x.tolist()) for x in ids], dtype=object)

    return tokens.select(*[F.col(f"`{c}`") for c in carried], texts("ids").alias("text"))


def token_digest(docs: DataFrame, model: str = MODEL, *carried: str) -> DataFrame:
    """Per row: carried columns, n_tokens, ids_md5 (of the ids as 32-bit little-endian numbers), and round_trip: decoding gives the
    text again, with its own space marks read as spaces."""
    pieces = docs.sparkSession.sparkContext.broadcast(load_model(model))

    @F.pandas_udf("n_tokens long, ids_md5 string, round_trip boolean")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(pieces.value)
        for texts in batches:
            rows = []
            for i in range(0, len(texts), TEXTS):
                part = [t or "" for t in texts.iloc[i : i + TEXTS]]
                for t, x in zip(part, encoder.encode(part)):
                    key = hashlib.md5(x.astype("<i4").tobytes()).hexdigest()
                    rows.append((len(x), key, encoder.decode(x.tolist()) == t.replace(MARK, " ")))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_md5", "round_trip"])

    return docs.select(*[F.col(f"`{c}`") for c in carried], digest("text").alias("d")).select(
        *[F.col(f"`{c}`") for c in carried], "d.n_tokens", "d.ids_md5", "d.round_trip"
    )


def piece_tokens(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document."""
    return token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), MODEL, "doc_id")
