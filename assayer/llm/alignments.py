"""Cross-tokenizer alignment: two tokenizers' tokens over the same bytes, and how often their ids stand for each other.

Tokenizer A (byte-level BPE) encodes a blank and the text, tokenizer B (SentencePiece BPE with byte fallback) the text, before which
it puts a blank itself. Byte offsets where tokens of both end cut them into groups; two tokens whose byte
ranges overlap are linked. The count of a pair of ids is the number of documents that hold it linked.

An array gives each A id the B id of the same bytes. A group of one A and one B id that are so related needs no
pair: its documents are counted in a vector as long as A's vocabulary, in every task, and so are links of
irregular groups whose ids are so related. Only other pairs, of irregular groups, enter the shuffle of
pairs, counted before it. Counts come back the same way: the vectors, as long as a vocabulary, are broadcast, and pairs
are joined to the documents that hold them.

Both tokenizers end a token before a blank that follows another character than white space. Texts are cut there, and what lies
between, such as a word with its blank, is aligned once for each batch that first meets it and then remembered.

A text that is null or empty, or whose tokens don't spell it (B takes U+2581 for a blank), has no tokens: all
numbers are zero and there is no digest. Rows count as documents, repeated rows each. Null ids are
kept. Other columns are ignored. Texts are aligned whole, however long: a worker holds a batch of 1 MB or one longer text, at some 80 bytes a byte.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.batches import bounded, ragged
from assayer.llm.pieces import SPACE, PieceModel
from assayer.llm.places import kept

CUT = re.compile(r"(?<=\S)(?=\x20)")
#: Distinct stretches, and their links, that a worker remembers between batches.
CACHE_WORDS, CACHE_LINKS = 500_000, 8_000_000
#: Stretches that are encoded at once.
CHUNK = 16384


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, their tokens' bytes, the identity map, and a bounded memory of aligned stretches."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = PieceModel(path_b)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.size_a, self.size_b = max(self.a.get_vocab().values()) + 1, self.b.size
        self.bytes_a = [b""] * self.size_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token))
        starts, lengths, blob = self.b.blob_start.tolist(), self.b.blob_length.tolist(), self.b.blob.tobytes()
        self.bytes_b = [blob[s : s + n] for s, n in zip(starts, lengths)]
        same = {t: i for i, t in reversed(list(enumerate(self.bytes_b))) if t}
        #: The identity map: A id to the least B id of the same bytes, -1 if there is none.
        self.same = np.array([same.get(t, -1) if t else -1 for t in self.bytes_a], np.int64)
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.decimal = list(map(str, range(max(self.size_a, self.size_b))))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.numbers = np.zeros((1 << 14, 5), np.int64)  # A ids, B ids, groups, links, whether it is spelt
        self.groups: list[str] = []
        self.links, self.start, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 14, np.int64), 0

    def encode_a(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all stretches, one after the other, and how many each has: encoded together, as tokens end where a stretch does.

        What ends in white space, or doesn't come back byte by byte, is encoded by itself.
        """
        sizes = np.array([len(s.encode()) for s in stretches])
        if not any(s[-1].isspace() for s in stretches[:-1]):
            ids = np.array(self.a.encode("".join(stretches), add_special_tokens=False).ids, np.int64)
            ends, wanted = np.cumsum(self.length_a[ids]), np.cumsum(sizes)
            at = np.searchsorted(ends, wanted)
            if len(ends) and ends[-1] == wanted[-1] and (ends[at] == wanted).all():
                return ids, np.diff(np.r_[-1, at])
        found = [e.ids for e in self.a.encode_batch(stretches, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.int64), np.array(list(map(len, found)))

    def learn(self, stretches: list[str]) -> None:
        """Align stretches, none of which was met before."""
        cut = self.b.words.findall
        stretches = sorted(stretches, key=lambda s: s[-1].isspace())
        for at in range(0, len(stretches), CHUNK):
            own = stretches[at : at + CHUNK]
            flat_a, count_a = self.encode_a(own)
            words = [cut(s.replace(" ", SPACE)) for s in own]
            flat_b, counts = self.b.merge(list(chain.from_iterable(words)))
            count_b = np.diff(np.r_[0, np.r_[0, np.cumsum(counts)][np.cumsum(list(map(len, words)))]])
            self.remember(own, flat_a, count_a, flat_b.astype(np.int64), count_b)

    def spelt(self, raw: list[bytes], tokens: list[bytes], lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each stretch, whether its tokens' bytes are its own."""
        if b"".join(map(tokens.__getitem__, ids.tolist())) == b"".join(raw):
            ends = np.r_[0, np.cumsum(lengths[ids])][np.cumsum(counts)]
            if (np.diff(np.r_[0, ends]) == list(map(len, raw))).all():
                return np.ones(len(raw), bool)
        ends = np.cumsum(counts).tolist()
        return np.array([b"".join(map(tokens.__getitem__, ids[e - n : e].tolist())) == r for r, e, n in zip(raw, ends, counts.tolist())])

    def remember(self, stretches: list[str], a: np.ndarray, count_a: np.ndarray, b: np.ndarray, count_b: np.ndarray) -> None:
        """Links and groups of all stretches at once: between two ends of tokens, of A or B, lies one link."""
        raw = [s.encode() for s in stretches]
        good = self.spelt(raw, self.bytes_a, self.length_a, a, count_a) & self.spelt(raw, self.bytes_b, self.length_b, b, count_b)
        a, b = a[np.repeat(good, count_a)], b[np.repeat(good, count_b)]
        ends = np.cumsum(np.where(good, list(map(len, raw)), 0))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        cuts = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        links = a[at_a] * self.size_b + b[at_b]
        common = (ends_a[at_a] == cuts) & (ends_b[at_b] == cuts) if len(cuts) else np.zeros(0, bool)
        last_a, last_b = at_a[common] + 1, at_b[common] + 1
        first_a, first_b = np.r_[0, last_a[:-1]], np.r_[0, last_b[:-1]]
        names_a, names_b = list(map(self.decimal.__getitem__, a.tolist())), list(map(self.decimal.__getitem__, b.tolist()))
        texts = [names_a[i] + "|" + names_b[k] if j == i + 1 and m == k + 1 else ",".join(names_a[i:j]) + "|" + ",".join(names_b[k:m]) for i, j, k, m in zip(first_a.tolist(), last_a.tolist(), first_b.tolist(), last_b.tolist())]
        n_links, until = (np.diff(np.r_[0, np.searchsorted(x, ends, side="right")]) for x in (cuts, cuts[common]))
        stop = np.cumsum(until).tolist()
        self.groups += [";".join(texts[e - n : e]) for e, n in zip(stop, until.tolist())]
        n, base = len(self.index), self.used
        self.used += len(links)
        while n + len(stretches) > len(self.numbers):
            self.numbers, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.numbers, self.start))
        while self.used > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.numbers[n : n + len(stretches)] = np.c_[count_a, count_b, until, n_links, good]
        self.links[base : self.used] = links
        self.start[n : n + len(stretches)] = base + np.cumsum(n_links) - n_links
        self.index.update(zip(stretches, range(n, n + len(stretches))))

    def align_all(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Numbers (A ids, B ids, groups, links) and digests of all texts; (text, link) keys and how often each occurs."""
        if len(self.index) > CACHE_WORDS or self.used > CACHE_LINKS:
            self.clear()
        stretches = [CUT.split(" " + t) if t else [] for t in texts]
        fresh = list(set(chain.from_iterable(stretches)).difference(self.index))
        if fresh:
            self.learn(fresh)
        sizes = np.fromiter(map(len, stretches), np.int64, len(texts))
        flat = np.fromiter(map(self.index.__getitem__, chain.from_iterable(stretches)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        spelt = np.bincount(text, self.numbers[flat, 4] == 0, len(texts)) == 0
        flat, text = flat[spelt[text]], text[spelt[text]]
        numbers = np.stack([np.bincount(text, self.numbers[flat, c], len(texts)) for c in range(4)], axis=1).astype(np.int64)
        groups, digests, at = list(map(self.groups.__getitem__, flat.tolist())), [], 0
        for n, own in zip(np.bincount(text, minlength=len(texts)).tolist(), numbers[:, 0].tolist()):
            digests.append(hashlib.sha256(";".join(groups[at : at + n]).encode()).hexdigest() if own else "")
            at += n
        links = self.links[ragged(self.numbers[flat, 3], self.start[flat])]
        keys = np.repeat(text, self.numbers[flat, 3]) * (self.size_a * self.size_b) + links
        return numbers, digests, *np.unique(keys, return_counts=True)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_times array<int>, pairs array<long>, pair_times array<int>"


def aligned(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, ALIGNED) of every row: distinct links by the identity map (``same``, A ids) and others (``pairs``), and their occurrences."""
    named = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()

    def lists(values: np.ndarray, text: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for b in bounded(batches, "text"):
            n = b.num_rows
            numbers, digests, keys, times = tool.align_all(b.column("text").to_pylist())
            owner, link = np.divmod(keys, tool.size_a * tool.size_b)
            a, other = np.divmod(link, tool.size_b)
            same = tool.same[a] == other
            columns = [pa.array(np.arange(row, row + n)), b.column("doc_id"), *map(pa.array, numbers.T), pa.array(digests, pa.string())]
            columns += [lists(a[same], owner[same], n, pa.int32()), lists(times[same], owner[same], n, pa.int32()), lists(link[~same], owner[~same], n, pa.int64()), lists(times[~same], owner[~same], n, pa.int32())]
            row += n
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *(c.split()[0] for c in ALIGNED.split(", "))])

    return named.mapInArrow(run, f"row long, doc_id {kind}, {ALIGNED}")


def same_counts(rows: DataFrame, size_a: int) -> np.ndarray:
    """For each A id, how many documents hold it linked to the B id of the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size_a, np.int64)
        for b in batches:
            counts += np.bincount(b.column("same").flatten().to_numpy(), minlength=size_a)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["a", "n"])

    found = rows.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    counts = np.zeros(size_a, np.int64)
    for a, n in found:
        counts[a] = n
    return counts


def counted(rows: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of aligned rows."""
    pairs = kept(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.expr(f"pair div {size_b}")
    counts = same_counts(rows, size_a)
    best = counts.copy()
    for i, n in pairs.groupBy(a.alias("a")).agg(F.max("n").alias("n")).collect():  # the vocabulary at most
        best[i] = max(best[i], n)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("pair").to_numpy() // size_b
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((b.column("n").to_numpy() == best[own]).astype(np.int64))], ["pair", "n", "top"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = counts == best
        for b in batches:
            same, times = b.column("same"), b.column("same_times").flatten().to_numpy()
            owner, own = np.repeat(np.arange(b.num_rows), same.value_lengths().to_numpy()), same.flatten().to_numpy()
            sums, n_best = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(sums, owner, times * counts[own])
            np.add.at(n_best, owner, times * top[own])
            plain = b.select(PLAIN)
            yield pa.RecordBatch.from_arrays([*plain.columns, pa.array(n_best), pa.array(sums)], [*PLAIN, "same_best", "same_sum"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    regular = rows.select(*PLAIN, "same", "same_times").mapInArrow(summed, f"row long, doc_id {kind}, {', '.join(ALIGNED.split(', ')[:5])}, same_best long, same_sum long")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "pair_times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.pair_times").cast("long").alias("times"))
    # Both joins are of tables that grow with the input: sorted at every size, and split where a pair is hot.
    met = links.join(pairs.mapInArrow(rated, "pair long, n long, top long").hint("merge"), "pair")
    irregular = met.groupBy("row").agg(F.sum(F.col("times") * F.col("top")).alias("pair_best"), F.sum(F.col("times") * F.col("n")).alias("pair_sum"))
    total = lambda x: (F.col(f"same_{x}") + F.coalesce(f"pair_{x}", F.lit(0))).cast("long")
    whole = regular.join(irregular.hint("merge"), "row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("best").alias("n_best"), total("sum").alias("count_sum"), "groups_sha256")


PLAIN = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def align(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's alignment and what the counts of the whole input say of its links."""
    tool = aligner(path_a, path_b)
    return counted(kept(aligned(df, path_a, path_b, key, text), "aligned"), tool.size_a, tool.size_b)


def op13_alignments(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
