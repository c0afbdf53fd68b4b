"""SentencePiece BPE encoding and decoding as vectorised merge rounds.

Text is cut into words where no vocabulary piece can reach across, distinct words are laid out as one
flat array of symbols, and every round merges in each word the leftmost pairs of the lowest rank. The
model file is read, never trained. Nulls count as empty texts; an empty text has no ids and decodes
to an empty text. Columns other than the key and the text are ignored; repeated rows are each encoded. Texts are encoded
whole, however long: a worker holds a batch of 1 MB or one longer text, at some 50 bytes a byte.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.batches import bounded, ragged

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Distinct words that a worker remembers between batches.
CACHE_WORDS = 250_000


class PieceModel:
    """The tables of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        spec = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix or kinds - {1, 2, 3, 6} or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no other normalisation are supported")
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        self.size = len(model.pieces)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.bytes_of = np.zeros(256, np.int32)
        blobs: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes_of[int(p.piece[3:5], 16)] = i
                blobs.append(bytes([int(p.piece[3:5], 16)]))
            else:
                blobs.append(p.piece.replace(SPACE, " ").encode() if p.type == 1 else " ⁇ ".encode() if p.type == 2 else b"")
        self.is_byte = np.array([p.type == 6 for p in model.pieces])
        self.is_control = np.array([p.type == 3 for p in model.pieces])
        self.blob_length = np.array([len(b) for b in blobs], np.int64)
        self.blob_start = np.cumsum(self.blob_length) - self.blob_length
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        # Symbols: pieces by id, then characters that only occur inside longer pieces.
        symbols = {s: i for s, (i, _) in normal.items()}
        for s in list(normal):
            for c in s:
                symbols.setdefault(c, self.size + len(symbols))
        self.width = max(symbols.values()) + 1
        ranks = {s: r for r, s in enumerate(sorted({-score for _, score in normal.values()}))}
        rows = [(symbols[s[:k]] * self.width + symbols[s[k:]], ranks[-score], i) for s, (i, score) in normal.items() for k in range(1, len(s)) if s[:k] in symbols and s[k:] in symbols]
        rows.sort()
        self.pair_key, self.pair_rank, self.pair_to = (np.array(x, t) for x, t in zip(zip(*rows), (np.int64, np.int32, np.int64)))
        points = sorted((ord(s), i) for s, i in symbols.items() if len(s) == 1)
        self.point, self.point_symbol = (np.array(x, np.int64) for x in zip(*points))
        inside = {c for s in normal for c in s}
        alone = "".join(c for c in "\n\r\t" if c not in inside)
        if any(re.search(f"[^{SPACE}]{SPACE}", s) for s in normal):
            self.words = re.compile("(?s).+")
        else:
            self.words = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]+" if alone else ""))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair in the pair table, -1 for those that never merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), at, -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.point, points), len(self.point) - 1)
        symbol = np.where(self.point[at] == points, self.point_symbol[at], -1 - points)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        order = np.arange(len(symbol))
        final_symbol, final_word, final_order = [], [], []
        row = np.full(len(symbol), -1)
        same = word[1:] == word[:-1]
        row[:-1] = np.where(same, self.lookup(symbol[:-1], symbol[1:]), -1)
        while len(symbol):
            rank = np.where(row >= 0, self.pair_rank[row], NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[first, len(word)])
            least = np.minimum.reduceat(rank, first)
            if (least == NONE).any():  # compaction: finished words leave
                live = np.repeat(least != NONE, length)
                final_symbol.append(symbol[~live])
                final_word.append(word[~live])
                final_order.append(order[~live])
                symbol, word, order, row, rank = symbol[live], word[live], order[live], row[live], rank[live]
                if not len(symbol):
                    break
                length, least = length[least != NONE], least[least != NONE]
            # The leftmost of overlapping pairs of the least rank: every other one in a run of neighbours.
            hit = np.flatnonzero(rank == np.repeat(least, length))
            head = np.r_[True, (hit[1:] != hit[:-1] + 1)]
            offset = np.arange(len(hit)) - np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
            hit = hit[offset % 2 == 0]
            # One by one, a merge may open a pair that comes before the next hit: later hits of that word wait.
            made, own = self.pair_to[row[hit]], word[hit]
            left = np.where(hit > 0, symbol[hit - 1], -1)
            touch = np.r_[False, hit[1:] == hit[:-1] + 2]
            left = np.where(touch, np.r_[-1, made[:-1]], left)
            left = np.where((hit > 0) & (word[hit - 1] == own), left, -1)
            after = np.minimum(hit + 2, len(symbol) - 1)
            right = np.where((hit + 2 < len(symbol)) & (word[after] == own), symbol[after], -1)
            new_left, new_right = self.lookup(left, made), self.lookup(made, right)
            opened = np.minimum(np.where(new_left >= 0, self.pair_rank[new_left], NONE), np.where(new_right >= 0, self.pair_rank[new_right], NONE)) <= rank[hit]
            seen = np.cumsum(opened) - opened
            begins = np.r_[True, own[1:] != own[:-1]]
            ready = seen == np.maximum.accumulate(np.where(begins, seen, 0))
            hit, made = hit[ready], made[ready]
            symbol[hit] = made
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # each earlier hit took one place away
            symbol, word, order, row = symbol[keep], word[keep], order[keep], row[keep]
            touched = np.zeros(len(symbol), bool)
            touched[moved] = True
            touched[moved[moved > 0] - 1] = True
            stale = np.flatnonzero(touched)
            nxt = np.minimum(stale + 1, len(symbol) - 1)
            row[stale] = np.where((stale + 1 < len(symbol)) & (word[nxt] == word[stale]), self.lookup(symbol[stale], symbol[nxt]), -1)
        symbol, word = np.concatenate(final_symbol or [symbol]), np.concatenate(final_word or [word])
        back = np.argsort(np.concatenate(final_order or [order]), kind="stable")
        symbol, word = symbol[back], word[back]
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.size))
        count = np.ones(len(symbol), np.int64)
        if len(odd):  # characters outside the vocabulary become their UTF-8 bytes
            known = {int(s): int(p) for p, s in zip(self.point, self.point_symbol)}
            raw = [chr(known[s] if s >= 0 else -1 - s).encode() for s in symbol[odd].tolist()]
            count[odd] = [len(b) for b in raw]
            out = np.repeat(symbol, count)
            foreign = np.zeros(len(symbol), bool)
            foreign[odd] = True
            out[np.repeat(foreign, count)] = self.bytes_of[np.frombuffer(b"".join(raw), np.uint8)]
            symbol, word = out, np.repeat(word, count)
        return symbol.astype(np.int32), np.bincount(word, minlength=len(words)).astype(np.int64)

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of id sequences laid one after the other; ``counts`` has the length of each."""
        ids = ids.astype(np.int64)
        lengths = self.blob_length[ids]
        data = self.blob[ragged(lengths, self.blob_start[ids])].tobytes()
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(counts)]
        first = np.r_[0, np.cumsum(counts)]
        texts, start = [], 0
        for k, end in enumerate(ends.tolist()):
            raw = data[start:end]
            start = end
            own = ids[first[k] : first[k + 1]]
            lead = own[: 1 + int(np.argmin(self.is_control[own]))][-1] if len(own) else -1
            if lead >= 0 and not self.is_byte[lead] and lead != self.unknown and raw[:1] == b" ":
                raw = raw[1:]
            if self.is_control[own].any():  # bytes on both sides of a control id make no character together
                runs = np.split(np.where(self.is_control[own], 0, self.blob_length[own]), np.flatnonzero(self.is_control[own]))
                cuts = np.cumsum([int(r.sum()) for r in runs])
                cuts -= cuts[-1] - len(raw)
                texts.append("".join(replaced(raw[max(a, 0) : max(b, 0)]) for a, b in zip([0, *cuts], cuts)))
                continue
            try:
                texts.append(raw.decode())
            except UnicodeDecodeError:
                texts.append(replaced(raw))
        return texts


def replaced(raw: bytes) -> str:
    """UTF-8 in which each byte that belongs to no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Encoder:
    """A model and a bounded memory of words that were encoded before."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.start, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def learn(self, words: list[str]) -> None:
        ids, counts = self.model.merge(words)
        base, n = self.used, len(self.index)
        while base + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(len(self.ids), np.int32)]
        while n + len(words) > len(self.start):
            self.start, self.count = (np.r_[x, np.zeros(len(x), np.int64)] for x in (self.start, self.count))
        self.ids[base : base + len(ids)] = ids
        self.count[n : n + len(words)] = counts
        self.start[n : n + len(words)] = base + np.cumsum(counts) - counts
        self.used = base + len(ids)
        self.index.update(zip(words, range(n, n + len(words))))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.index) > CACHE_WORDS or self.used > 16 * CACHE_WORDS:
            self.clear()
        cut = self.model.words.findall
        words = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = list(set(chain.from_iterable(words)).difference(self.index))
        if fresh:
            self.learn(fresh)
        get = self.index.__getitem__
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter(map(get, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        lengths = self.count[flat]
        ids = self.ids[ragged(lengths, self.start[flat])]
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(sizes)]
        return ids, np.diff(np.r_[0, ends])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model)
        for b in bounded(batches, text):
            ids, counts = tool.encode_all([t or "" for t in b.column(text).to_pylist()])
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(offsets, pa.array(ids))], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row's ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model).model
        for b in batches:
            rows = [np.array(x or [], np.int64) for x in b.column(ids).to_pylist()]
            texts = tool.decode_all(np.concatenate([*rows, np.zeros(0, np.int64)]), np.array([len(x) for x in rows], np.int64))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def digests(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass: (key, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model)
        decimal = list(map(str, range(tool.model.size)))
        for b in bounded(batches, text):
            ids, counts = tool.encode_all([t or "" for t in b.column(text).to_pylist()])
            texts = tool.model.decode_all(ids, counts)
            names = list(map(decimal.__getitem__, ids.tolist()))
            ends = np.cumsum(counts).tolist()
            listed = [hashlib.sha256(",".join(names[e - n : e]).encode()).hexdigest() for e, n in zip(ends, counts.tolist())]
            decoded = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(counts), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_token_ids(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """All columns of ``df`` with ``token_ids``, ``n_tokens`` and ``decoded_sha256`` added, or replaced if they were there."""
    kept = df.drop("token_ids", "n_tokens", "decoded_sha256")
    names = kept.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", token_ids array<int>, n_tokens long, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model)
        for b in bounded(batches, text):
            ids, counts = tool.encode_all([t or "" for t in b.column(text).to_pylist()])
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            decoded = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in tool.model.decode_all(ids, counts)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(counts), decoded], [*names, "token_ids", "n_tokens", "decoded_sha256"])
        tool.clear()  # a worker outlives the stage: what it remembers is for one task

    return kept.mapInArrow(run, schema)


def op1_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
