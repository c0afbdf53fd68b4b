"""Token-id files: documents as ids, grammar-compressed by Re-Pair in shards that decode at random places.

Text is encoded by a tokenizer file of the tokenizers library, distinct words once per worker, and every
document ends with an end id. Documents are range-partitioned by id; a task cuts its documents, in order,
into shards of about ``SHARD_IDS`` ids. A shard repeatedly replaces frequent pairs of ids by nonterminals,
never across documents, and holds a header, the rules, each rule's expansion length, each document's first
symbol and first id, and the remaining symbols:

    magic RPG1, then as little-endian uint32: documents, rules, symbols, vocabulary, bytes a symbol
    rules (two symbols each), rule lengths, first symbol of each document and the end, as uint32
    first id of each document and the end, as uint64; symbols, as uint16 or uint32

Shards are rows of a Parquet table, so that any store that Spark reaches holds them. A null text is empty
and has the end id alone. Null document ids come first; equal ids are ordered by a hash of their text.
Repeated rows each have their place; other columns are ignored. Texts are encoded whole, however long: a worker holds a shard, a
batch of 1 MB or one longer text, at some 60 bytes a byte.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.batches import bounded, ragged, text_bytes
from assayer.llm.places import kept, shared_folder

SHARD_IDS = 1 << 18
#: From so many places a rule pays: it takes two symbols and a length, 8 bytes, and each place saves a symbol, 2 bytes.
LEAST_COUNT = 5
CACHE_WORDS = 1_000_000
#: Parts, each the work of a task, whose starts (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_PARTS = 1_000_000
#: Closing marks of a word: all ASCII marks, which are one word to the tokenizer where they follow letters.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MAGIC = b"RPG1"


class WordMemory:
    """Numbers of words. Words of up to 15 bytes are kept by their bytes and length in an open-addressed table of two
    64-bit numbers each, so that a whole batch is looked up at once; longer, rarer words are kept in a dictionary."""

    SHORT = 15
    MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self) -> None:
        self.size, self.long = 0, {}
        self.first, self.second = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)
        self.slots = np.full(1 << 15, -1, np.int32)

    @classmethod
    def keys(cls, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two numbers of each word, and which words are short."""
        body, at = text_bytes(words)
        lengths = np.diff(at)
        eight = np.ndarray(len(body) + 9, "<u8", np.r_[body, np.zeros(16, np.uint8)], strides=(1,))
        first = eight[at[:-1]] & cls.MASKS[np.minimum(lengths, 8)]
        second = eight[np.minimum(at[:-1] + 8, len(body))] & cls.MASKS[np.clip(lengths - 8, 0, 7)]
        return first, second | lengths.astype(np.uint64) << np.uint64(56), lengths <= cls.SHORT

    @staticmethod
    def slot(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
        h = (first ^ second * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 for those not met before."""
        first, second, short = self.keys(words)
        out, left = np.full(len(words), -1, np.int64), np.flatnonzero(short)
        at = self.slot(first[left], second[left], len(self.slots).bit_length() - 1)
        while len(left):
            got = self.slots[at]
            same = (got >= 0) & (self.first[got] == first[left]) & (self.second[got] == second[left])
            out[left[same]] = got[same]
            on = (got >= 0) & ~same
            left, at = left[on], at[on] + 1 & len(self.slots) - 1
        rest = np.flatnonzero(~short)
        out[rest] = [self.long.get(w, -1) for w in words.take(pa.array(rest)).to_pylist()]
        return out

    def add(self, words: pa.Array) -> None:
        """Numbers for distinct words, none of which was met before, in order."""
        first, second, short = self.keys(words)
        start, self.size = self.size, self.size + len(words)
        while self.size > len(self.first):
            self.first, self.second = (np.r_[x, np.zeros(len(x), np.uint64)] for x in (self.first, self.second))
        self.first[start : self.size], self.second[start : self.size] = first, second
        rest = np.flatnonzero(~short)
        self.long.update(zip(words.take(pa.array(rest)).to_pylist(), (start + rest).tolist()))
        fresh = start + np.flatnonzero(short)
        if 2 * self.size > len(self.slots):
            fresh = np.r_[self.slots[self.slots >= 0].astype(np.int64), fresh]
            self.slots = np.full(1 << (4 * self.size).bit_length(), -1, np.int32)
        at = self.slot(self.first[fresh], self.second[fresh], len(self.slots).bit_length() - 1)
        while len(fresh):
            free = self.slots[at] < 0
            self.slots[at[free]] = fresh[free]
            on = self.slots[at] != fresh
            fresh, at = fresh[on], at[on] + 1 & len(self.slots) - 1


class WordEncoder:
    """A tokenizer whose words end at blanks, and a bounded memory of the words it met.

    It normalises by NFC, blanks and lower case, so that lower-casing A-Z beforehand changes nothing (but where a
    text spells a special token), and words of the letters a-z need no normalising at all.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tool, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.vocabulary = self.tool.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for s, i in self.tool.get_vocab(with_added_tokens=False).items() if s.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.words = WordMemory()
        self.ids, self.start, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0

    @staticmethod
    def latin(word: str) -> bool:
        """Letters of the Latin blocks alone, none of which falls apart when normalised."""
        return word.isalpha() and max(word) < "ɐ" and "İ" not in word

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts. A word of letters with closing marks is one or two words to the tokenizer, so many of
        them go in one call that is cut at the ends of words; the others go one by one."""
        core = pc.ascii_rtrim(words, MARKS)
        marked = pc.not_equal(pc.binary_length(core), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        small = pc.and_(pc.string_is_ascii(core), pc.and_(pc.ascii_is_alpha(core), pc.ascii_is_lower(core))).to_numpy(zero_copy_only=False)
        text = words.to_numpy(zero_copy_only=False).tolist()
        easy = small.copy()
        rest = np.flatnonzero(~small)
        latin = rest[[self.latin(c) for c in core.take(pa.array(rest)).to_pylist()]]
        easy[latin] = True
        for i in latin.tolist():
            text[i] = text[i].lower()
        at = np.flatnonzero(easy)
        joined = [text[i] for i in at.tolist()]
        lines = [" ".join(joined[k : k + 256]) for k in range(0, len(at), 256)]
        got = [np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([*got, np.zeros(0, np.uint32)])
        stops, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(1 + marked[at])
        if len(stops) != (last[-1] if len(at) else 0) or len(ids) != (stops[-1] if len(at) else 0):
            at, ids, stops, last = at[:0], ids[:0], stops[:0], last[:0]  # ends don't tell these words apart
        counts, source = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        counts[at] = np.diff(np.r_[0, stops[last - 1]])
        source[at] = np.cumsum(counts[at]) - counts[at]
        hard = np.ones(len(text), bool)
        hard[at] = False
        at = np.flatnonzero(hard)
        got = [np.array(e.ids, np.uint32) for e in self.tool.encode_batch_fast(words.take(pa.array(at)).to_pylist(), add_special_tokens=False)]
        counts[at] = [len(x) for x in got]
        source[at] = len(ids) + np.cumsum(counts[at]) - counts[at]
        return np.concatenate([ids, *got])[ragged(counts, source)], counts

    def learn(self, words: pa.Array) -> None:
        ids, counts = self.encode_words(words)
        base, n = self.used, self.words.size
        while base + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(len(self.ids), np.uint32)]
        while n + len(words) > len(self.start):
            self.start, self.count = (np.r_[x, np.zeros(len(x), x.dtype)] for x in (self.start, self.count))
        self.ids[base : base + len(ids)] = ids
        self.count[n : n + len(words)] = counts
        self.start[n : n + len(words)] = base + np.cumsum(counts) - counts
        self.used = base + len(ids)
        self.words.add(words)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; nulls have none."""
        if self.words.size > CACHE_WORDS or self.used > 16 * CACHE_WORDS:
            self.clear()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        own = self.words.find(coded.dictionary)
        fresh = np.flatnonzero(own < 0)
        if len(fresh):
            own[fresh] = self.words.size + np.arange(len(fresh))
            self.learn(coded.dictionary.take(pa.array(fresh)).cast(pa.string()))
        at = own[coded.indices.to_numpy()]
        lengths = self.count[at].astype(np.int64)
        ids = self.ids[ragged(lengths, self.start[at])]
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(pc.list_value_length(lists).to_numpy())]
        return ids, np.diff(np.r_[0, ends])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def winners(at: np.ndarray, rank: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` (ascending) are replaced where neighbouring pairs share a symbol: the higher rank wins."""
    won, left = np.zeros(len(at), bool), None
    while left is None or len(left):
        here, own = (at, rank) if left is None else (at.take(left), rank.take(left))
        touch, more = after.take(here[:-1]) == here[1:], own[:-1] > own[1:]
        free = np.ones(len(here), bool)
        free[1:] = ~(touch & more)
        free[:-1] &= ~(touch & ~more)
        open_ = ~free  # beaten, but perhaps by a pair that is itself beaten
        open_[1:] &= ~(touch & free[:-1])
        open_[:-1] &= ~(touch & free[1:])
        if left is None:
            won, left = free, np.flatnonzero(open_)
        else:
            won[left[free]] = True
            left = left[open_]
    return won


def grammar(ids: np.ndarray, counts: np.ndarray, vocabulary: int, least: int = LEAST_COUNT):
    """(symbols, first symbol of each document and the end, rules, rule lengths) of ids laid end to end.

    A round counts the pairs that may occur ``least`` times, makes a rule of each that does and replaces it
    everywhere; where two overlap, the more frequent pair wins, and a pair that is left with too few places gets no
    rule. Only pairs that a replacement made or that shared a counter with another are counted again; rounds go on
    until there are none, so that no pair of the result occurs ``least`` times.
    """
    n = len(ids)
    symbols = np.zeros(n + 1, np.int64)
    symbols[:n] = ids
    ends = np.cumsum(counts)[counts > 0] - 1
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # neighbours; n is none
    after[ends], before[ends + 1], before[0] = n, n, n
    alive, active = np.ones(n, bool), np.ones(n + 1, bool)
    active[ends] = active[n] = False
    rules, lengths, salt = [np.zeros((0, 2), np.int64)], np.ones(vocabulary, np.int64), 0
    while len(at := np.flatnonzero(active)):
        left, right = symbols.take(at), symbols.take(after.take(at))
        key = left << 32
        key |= right
        bits = max(8, len(at).bit_length())
        salt += 1
        slot = key * np.int64(-7046029254386353131 + 2 * salt)
        slot >>= np.int64(64 - bits)
        slot &= np.int64((1 << bits) - 1)
        holder = np.empty(1 << bits, np.int64)
        holder[slot] = key
        sure = holder.take(slot) == key  # a pair that lost its counter to another is counted again
        counted = sure
        alike = np.flatnonzero(left == right)
        if len(alike):  # in a run of one pair every other place counts
            starts = np.r_[True, after[at[alike[:-1]]] != at[alike[1:]]]
            offset = np.arange(len(alike)) - np.maximum.accumulate(np.where(starts, np.arange(len(alike)), 0))
            counted = sure.copy()
            counted[alike[offset % 2 == 1]] = False
        times = np.bincount(slot[counted], minlength=1 << bits)
        own = times.take(slot)
        often = own >= least
        active[at[sure & ~often]] = False
        chosen = np.flatnonzero(counted & often)
        if not len(chosen):
            continue
        place, of = at.take(chosen), slot.take(chosen)
        rank = own.take(chosen) << bits | of
        won = winners(place, rank, after)
        kept = np.bincount(of[won], minlength=1 << bits) >= least
        rest = kept.take(of)
        won &= rest
        rest &= ~won
        # Places of these pairs that only stood back for pairs without a rule.
        rest = np.flatnonzero(rest)
        taken = np.zeros(n + 1, bool)
        taken[place[won]] = taken[after[place[won]]] = True
        rest = rest[~(taken[place[rest]] | taken[after[place[rest]]])]
        if len(rest):
            won[rest[winners(place[rest], rank[rest], after)]] = True
        place, of = place[won], of[won]
        used = np.flatnonzero(kept)
        name = np.empty(1 << bits, np.int64)
        name[used] = len(lengths) + np.arange(len(used))
        symbols[place] = name.take(of)
        new = np.stack([holder[used] >> 32, holder[used] & 0xFFFFFFFF], axis=1)
        rules.append(new)
        lengths = np.r_[lengths, lengths[new[:, 0]] + lengths[new[:, 1]]]
        gone = after.take(place)
        follow = after.take(gone)
        after[place], before[follow] = follow, place
        alive[gone], active[gone] = False, False
        active[place] = follow < n
        active[before.take(place)] = True
        active[n] = False
    ends_of = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=ends_of[1:])
    return symbols[:n][alive], np.r_[0, np.cumsum(alive)][ends_of], np.concatenate(rules), lengths[vocabulary:]


def narrow(values: np.ndarray, width: int) -> bytes:
    """Little-endian integers of ``width`` bytes."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def pack(ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> bytes:
    symbols, starts, rules, lengths = grammar(ids, counts, vocabulary)
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 3 if vocabulary + len(rules) <= 1 << 24 else 4
    head = MAGIC + struct.pack("<5I", len(counts), len(rules), len(symbols), vocabulary, width)
    return b"".join([head, narrow(rules.ravel(), width), lengths.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), np.r_[0, np.cumsum(counts)].astype("<u8").tobytes(), narrow(symbols, width)])


class Shard:
    """A packed shard: ids of any of its documents, or of any part of one, without decoding the rest."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        self.documents, rules, symbols, self.vocabulary, width = struct.unpack("<5I", data[4:24])
        at = 24

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        def wide(n: int) -> np.ndarray:
            out = np.zeros((n, 4), np.uint8)
            out[:, :width] = take(n * width, "u1").reshape(-1, width)
            return out.view("<u4").ravel()

        self.rules = wide(2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take(rules, "<u4").astype(np.int64)
        self.first_symbol = take(self.documents + 1, "<u4").astype(np.int64)
        self.first_id = take(self.documents + 1, "<u8").astype(np.int64)
        self.symbols = wide(symbols)

    def size(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols - self.vocabulary
        return np.where(rule < 0, 1, np.r_[self.lengths, 0][np.maximum(rule, -1)])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        while len(deep := np.flatnonzero(symbols >= self.vocabulary)):
            twice = np.ones(len(symbols), np.int64)
            twice[deep] = 2
            out = np.repeat(symbols, twice)
            at = deep + np.arange(len(deep))
            pair = self.rules[symbols[deep] - self.vocabulary]
            out[at], out[at + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols.astype(np.uint32)

    def all_ids(self) -> np.ndarray:
        """Ids of all documents, one after the other: every rule is expanded once, then symbols are looked up."""
        rules = self.rules
        length = np.r_[np.ones(self.vocabulary, np.int64), self.lengths]
        start = np.r_[np.arange(self.vocabulary), self.vocabulary + np.cumsum(self.lengths) - self.lengths]
        table = np.zeros(self.vocabulary + int(self.lengths.sum()), np.uint32)
        table[: self.vocabulary] = np.arange(self.vocabulary)
        needs, done = rules.max(axis=1, initial=0) - self.vocabulary, 0
        while done < len(rules):  # rules whose parts are expanded
            later = np.flatnonzero(needs[done:] >= done)
            stop = done + int(later[0]) if len(later) else len(rules)
            left, right, into = rules[done:stop, 0], rules[done:stop, 1], start[self.vocabulary + done : self.vocabulary + stop]
            table[ragged(length[left], into)] = table[ragged(length[left], start[left])]
            table[ragged(length[right], into + length[left])] = table[ragged(length[right], start[right])]
            done = stop
        return table[ragged(length[self.symbols], start[self.symbols])]

    def ids(self, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of a document; only symbols that reach into that range are expanded."""
        own = self.symbols[self.first_symbol[document] : self.first_symbol[document + 1]].astype(np.int64)
        if start == 0 and stop is None:
            return self.expand(own)
        ends = np.cumsum(self.size(own))
        stop = int(ends[-1]) if stop is None and len(ends) else min(stop or 0, int(ends[-1]) if len(ends) else 0)
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(own[a:b])[start - skipped : stop - skipped]


def write(df: DataFrame, tokenizer: str, folder: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encode every row's whole text and write shards in ascending order of ``key``."""
    out = pa.schema([("part", pa.int64()), ("before", pa.int64()), ("keys", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("shard", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = word_encoder(tokenizer)
        part, before, held, keys, sizes = TaskContext.get().partitionId(), 0, [], [], []

        def close() -> pa.RecordBatch:
            counts = np.array(sizes, np.int64)
            return pa.RecordBatch.from_pylist([{"part": part, "before": before, "keys": keys, "n_ids": int(counts.sum()), "shard": pack(np.concatenate(held), counts, tool.vocabulary)}], out)

        for b in bounded(batches, text, 1 << 20):
            ids, counts = tool.encode_all(b.column(text))
            stops = np.cumsum(counts)
            ids = np.insert(ids, stops, np.uint32(end_id))
            held.append(ids)
            keys += b.column(key).to_pylist()
            sizes += (counts + 1).tolist()
            if sum(map(len, held)) >= SHARD_IDS:
                yield close()
                before, held, keys, sizes = before + sum(sizes), [], [], []
        if keys:
            yield close()

    ordered = df.select(F.col(key).cast("long").alias(key), text).orderBy(F.col(key).asc_nulls_first(), F.xxhash64(text))
    ordered.mapInArrow(run, "part long, before long, keys array<long>, n_ids long, shard binary").write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of every document in the files of a folder."""
    return _decoded(spark, folder, "ids array<int>", pa.list_(pa.int32()), lambda ids, bounds: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))


def checksums(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The CRC-32 of each document's ids."""
    raw = memoryview(ids.astype("<u4")).cast("B")
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip((4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist())], pa.int64())


def _decoded(spark: SparkSession, folder: str, column: str, kind: pa.DataType, of) -> DataFrame:
    """A shard knows the ids before it in its part, so only the parts' starts are joined: a row for each writing task."""
    files = spark.read.parquet(folder)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = kept(parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("part_start")), "parts")
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts
    name = column.split()[0]
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, keys, first = Shard(b.column("shard")[i].as_py()), b.column("keys")[i].values, b.column("first")[i].as_py()
                begin = shard.first_id
                yield pa.RecordBatch.from_arrays([keys, pa.array(begin[:-1] + first), pa.array(np.diff(begin)), of(shard.all_ids(), begin)], schema=out)

    starts = files.join(parts, "part").select("keys", "shard", (F.col("before") + F.col("part_start")).alias("first"))
    return starts.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def op7_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = shared_folder(spark, "tokens")
    write(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return _decoded(spark, folder, "ids_crc32 long", pa.int64(), checksums)
