"""Secrets: fixed patterns, and a guess-cost search over values that stand in a credential context.

The guess cost of a value is the least, over all ways to cut it into parts, of the product of the parts'
guesses: a part is a word of a list (by its place in it), a date, a repeat of a character or a block, a run along the
keyboard or the alphabet, or a brute-force span of characters. The list has some common passwords and then the words of
all texts of the input, the most frequent first, that make up at least one in ``LEARNED`` of all words: never more than ``LEARNED``
words, the same ones whatever the size of an input of the same kind. Values whose log10 cost reaches ``threshold`` are spans of
kind ``guess``, of any length and of any characters. A value in quotes ends with them, another before blanks, quotes
and ``<>,;``. After a name and blanks alone, without ``:`` or ``=``, the next word may be prose, and a value must cost
``blank_threshold``. Values of the base
patterns keep their base span whatever their cost, and no guess span overlaps one: what a base span leaves of its value is
a guess span of its own if the whole value's cost or its own reaches the threshold. A null text counts as empty and has no spans. Other columns are ignored; repeated rows are
each judged. Texts are read whole, however long, and once: what is judged later, spans, values and counts of words, is kept.
A worker holds a batch of 1 MB or one longer text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.batches import bounded
from assayer.llm.places import kept

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: The value is looked at and not consumed: a name inside it is a context of its own.
VALUE = r"""(?=(?:"([^\s"]+)"|'([^\s']+)'|["']?([^\s"'<>,;]+)))"""
NAME = r"(?:password|passwd|secret|token|api[_-]?key|(?<![A-Za-z])(?:pwd|pass[_-]?phrase|credentials?|auth|bearer|private[_-]?key|client[_-]?id|access[_-]?key|login|passcode|pin))[\"']?"
CREDENTIAL = re.compile(NAME + r"(?:[\x20\t]*+[:=][\x20\t]*+|([\x20\t]++))" + VALUE, re.I | re.A)
URL_LOGIN = re.compile(r"://[^\s/:@]+:([^\s/@]+)@")
ORDER = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
HINTS = (b"passw", b"secret", b"token", b"api")
MORE_HINTS = (*HINTS, b"pwd", b"passp", b"passc", b"pass_p", b"pass-p", b"credential", b"auth", b"bearer", b"private", b"client", b"access", b"login", b"pin")
#: Common passwords, the most frequent first.
WORDS = "password pass admin welcome login secret letmein monkey dragon master hello freedom shadow summer winter spring autumn test user root default changeme token key love money computer internet access server public private example sample none null true false".split()
#: Words that make up one in LEARNED of all words are learned, so LEARNED at most; and their letters.
LEARNED, LETTERS = 50_000, (3, 20)
#: log10 costs that make a secret: of a value behind a sign, and of one behind blanks alone.
THRESHOLD, BLANK_THRESHOLD = 9.0, 12.0
#: log10 costs from here on are not told apart.
CEILING = 18.0
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qwertzuiop", "azertyuiop")
NEXT = {(a, b) for row in ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:])}
DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?[01]?\d[-./]?[0-3]?\d)?|[0-3]?\d[-./][01]?\d[-./](?:19|20)?\d\d")
LEET = str.maketrans("013457@$", "oieastas")


class Pushed:
    """Starts of a growing part that costs log10 of its size on top of its start: the cheapest at each end.

    A start that an earlier one beats at some end is beaten at all later ends, as the sizes' ratio only falls, and
    so it is dropped; what is left stays short.
    """

    def __init__(self) -> None:
        self.starts: list[tuple[int, float]] = []

    def least(self, end: int, unit: int) -> float:
        cheapest, left = math.inf, []
        for s, cost in self.starts:
            if (now := cost + math.log10((end - s) // unit)) < cheapest:
                cheapest = now
                left.append((s, cost))
        self.starts = left
        return cheapest


class Guesser:
    """The guess cost of values under a ranked list of words."""

    def __init__(self, learned: Sequence[str] = ()):
        self.rank: dict[str, int] = {}
        for w in (*WORDS, *learned):
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))

    def cost(self, value: str, limit: float = CEILING) -> float:
        """log10 of the guesses of the cheapest segmentation; ``limit`` if it is that or more.

        Starts that cost the limit already lead to nothing cheaper and are left out, and with them the longer
        blocks, whose characters alone cost as much. Time grows with the value's length.
        """
        low, n = value.lower(), len(value)
        if len(low) != n:  # a few letters lower to two
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = low.translate(LEET)
        pool = sum(size for size, has in ((10, re.search("[0-9]", value)), (26, re.search("[a-z]", value)), (26, re.search("[A-Z]", value)), (33, re.search("[^A-Za-z0-9]", value))) if has)
        char = math.log10(max(pool, 2))
        best = [0.0] + [math.inf] * n
        longest_block = max(1, min(n // 2, int(limit / char)))
        alike = [0] * (longest_block + 1)  # for each size, how many characters up to here equal the one that far before
        walks, repeats, blocks = Pushed(), Pushed(), [[Pushed() for _ in range(size)] for size in range(longest_block + 1)]
        walk = repeat = alive = 0  # where the run that ends here starts; the last start below the limit
        for e in range(1, n + 1):
            i, cheapest = e - 1, math.inf
            if best[i] < limit:
                cheapest = best[i] + char  # a brute-force span grows by one character
            if i and (low[i - 1], low[i]) not in NEXT:
                walk, walks = i, Pushed()
            if i and low[i] != low[i - 1]:
                repeat, repeats = i, Pushed()
            for run, start, guesses in ((walks, walk, 40), (repeats, repeat, pool)):
                if e - start >= 3:
                    if best[e - 3] < limit:
                        run.starts.append((e - 3, best[e - 3]))
                    if run.starts:
                        cheapest = min(cheapest, run.least(e, 1) + math.log10(guesses))
            for size in range(2, min(i, longest_block) + 1):  # a block said twice or more
                if low[i] != low[i - size]:
                    if alike[size] >= size:
                        blocks[size] = [Pushed() for _ in range(size)]
                    alike[size] = 0
                    continue
                alike[size] += 1
                if alike[size] >= size:
                    said = blocks[size][e % size]
                    if best[e - 2 * size] < limit:
                        said.starts.append((e - 2 * size, best[e - 2 * size]))
                    if said.starts:
                        cheapest = min(cheapest, said.least(e, size) + size * char)
            for s in range(max(0, e - self.longest), e - 2):
                if best[s] < limit:
                    for shape in (low, plain):
                        if (r := self.rank.get(shape[s:e])) is not None:
                            changed = value[s:e] != low[s:e] or (shape is plain and plain[s:e] != low[s:e])
                            cheapest = min(cheapest, best[s] + math.log10(2 * r * (4 if changed else 1)))
            for s in range(max(0, e - 10), e - 3):
                if best[s] < limit and DATE.fullmatch(value, s, e):
                    cheapest = min(cheapest, best[s] + math.log10(365 * 120))
            best[e] = cheapest
            if cheapest < limit:
                alive = e
            elif e - alive > max(self.longest, 10) and walk > alive and repeat > alive and all(a + size < e - alive for size, a in enumerate(alike)):
                return limit  # no part that ends from here on can start below the limit
        return min(best[n], limit)


COMMON = Guesser()


def word_counts(texts: pa.Array) -> pa.StructArray:
    """(values, counts) of the words of some texts: runs of the letters a-z, lower-cased, between blanks and marks."""
    lo, hi = LETTERS
    words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[^a-z]+").flatten()
    size = pc.binary_length(words)
    return pc.value_counts(words.filter(pc.and_(pc.greater_equal(size, lo), pc.less_equal(size, hi))))


def frequent(counts: DataFrame, most: int = LEARNED) -> list[str]:
    """The words of counts (word, n) that make up one in ``most`` of all, so ``most`` at the very most; the first ones first, ties in their order."""
    counted = kept(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counted.agg(F.sum("n").alias("n")).head().n or 0
    return [r.word for r in sorted(counted.filter(F.col("n") * most >= total).collect(), key=lambda r: (-r.n, r.word))]


def learned_words(df: DataFrame, text: str = "text", most: int = LEARNED) -> list[str]:
    """The frequent words of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, text):
            counts = word_counts(b.column(text))
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["word", "n"])

    return frequent(df.select(text).mapInArrow(run, "word string, n long"), most)


def base_spans(text: str, low: bytes) -> list[tuple[str, int, int]]:
    found = []
    if any(h in low for h in HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in low:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def contexts(text: str, low: bytes) -> Iterator[tuple[int, int, bool]]:
    """Where the values stand that a name or a login of a URL makes credentials, and whether only blanks stand before them."""
    if any(h in low for h in MORE_HINTS):
        for m in CREDENTIAL.finditer(text):
            yield *m.span(m.lastindex), m[1] is not None
    if b"://" in low:
        for m in URL_LOGIN.finditer(text):
            yield *m.span(1), False


def uncovered(s: int, e: int, taken: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """What spans leave of s..e."""
    out = []
    for a, b in sorted(taken):
        if a < e and b > s:
            if a > s:
                out.append((s, a))
            s = max(s, b)
    return [*out, (s, e)] if s < e else out


def guess_spans(values: Sequence[tuple[int, str, bool]], base: Sequence[tuple[str, int, int]], guesser: Guesser, threshold: float = THRESHOLD, blank_threshold: float = BLANK_THRESHOLD) -> list[tuple[str, int, int]]:
    """Values (start, value, after blanks alone) that no base span covers, and what base spans leave of a value, by cost alone."""
    out: list[tuple[str, int, int]] = []
    taken = [(a, b) for _, a, b in base]
    for s, value, blank in values:
        e, limit = s + len(value), blank_threshold if blank else threshold
        rests = uncovered(s, e, taken)
        whole = bool(rests) and guesser.cost(value, limit) >= limit
        for a, b in rests:
            rest = value[a - s : b - s]
            if b - a < e - s and not rest.strip(")]}") and not re.search(r"[(\[{]", value):
                continue  # closes a bracket around the assignment
            if whole or guesser.cost(rest, limit) >= limit:
                out.append(("guess", a, b))
                taken.append((a, b))
    return out


def place(span: tuple[str, int, int]) -> tuple[int, int]:
    return span[1], ORDER[span[0]]


def candidates(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[int, str, bool]]]:
    """Base spans by start and kind, and the values (start, value, after blanks alone) that costs decide on."""
    if not text:
        return [], []
    low = text.encode().lower()
    return sorted(base_spans(text, low), key=place), [(s, text[s:e], blank) for s, e, blank in contexts(text, low)]


def spans(text: str | None, threshold: float = THRESHOLD, guesser: Guesser = COMMON, blank_threshold: float = BLANK_THRESHOLD) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, by start and kind."""
    base, values = candidates(text)
    return base, sorted(base + guess_spans(values, base, guesser, threshold, blank_threshold), key=place) if values else base


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def scanned(df: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over all texts: a row for each text with its base spans and the values to judge, and one for each batch with its words."""
    kind = df.schema[key].dataType.simpleString()
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string())]))
    value_type = pa.list_(pa.struct([("start", pa.int64()), ("value", pa.string()), ("blank", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, text):
            bases, values, n = [], [], b.num_rows
            for t in b.column(text).to_pylist():
                base, own = candidates(t)
                bases.append([(k, s, e, ASSIGN.match(t, s, e)[2] if k == "assign" else None) for k, s, e in base])
                values.append(own)
            counts = word_counts(b.column(text))
            alone = pa.array([False] * n + [True])
            words, times = (pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(counts)], pa.int32()), x) for x in (counts.field(0), counts.field(1)))
            keys = pa.concat_arrays([b.column(key), pa.nulls(1, b.column(key).type)])
            yield pa.RecordBatch.from_arrays([keys, pa.array([*bases, []], base_type), pa.array([*values, []], value_type), alone, words, times], ["key", "base", "candidates", "counted", "words", "times"])

    schema = f"key {kind}, base array<struct<kind:string,start:long,stop:long,value:string>>, candidates array<struct<start:long,value:string,blank:boolean>>, counted boolean, words array<string>, times array<long>"
    return df.select(key, text).mapInArrow(run, schema)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, blank_threshold: float = BLANK_THRESHOLD) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, guess_log10) of every row."""
    seen = kept(scanned(df, key, text), "scanned")
    words = seen.filter("counted").select(F.explode(F.arrays_zip("words", "times")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    shared = df.sparkSession.sparkContext.broadcast(Guesser(frequent(words)))  # LEARNED words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = shared.value
        for b in batches:
            counts, digest, lists, cost = [], [], [], []
            for found, given in zip(b.column("base").to_pylist(), b.column("candidates").to_pylist()):
                base, values = [(x["kind"], x["start"], x["stop"]) for x in found], [(x["start"], x["value"], x["blank"]) for x in given]
                guessed = guess_spans(values, base, guesser, threshold, blank_threshold) if values else []
                named = {(x["kind"], x["start"], x["stop"]): x["value"] for x in found}
                for k, s, e in guessed:
                    named[k, s, e] = next(v[s - a : e - a] for a, v, _ in values if a <= s and e <= a + len(v))
                both = sorted(base + guessed, key=place)
                counts.append([sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")])
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(both))
                cost.append([round(guesser.cost(named[x]), 6) if named[x] else None for x in both])
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(x, pa.int64()) for x in zip(*counts)), pa.array(digest, pa.string()), pa.array(lists, pa.string()), pa.array(cost, pa.list_(pa.float64()))], [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "guess_log10"])

    rows = seen.filter("not counted").select("key", "base", "candidates")
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, guess_log10 array<double>")


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]", threshold: float = THRESHOLD, blank_threshold: float = BLANK_THRESHOLD) -> DataFrame:
    """All columns and rows of ``df``; every span of ``text`` is replaced by ``mark``, nulls stay null."""
    shared = df.sparkSession.sparkContext.broadcast(Guesser(learned_words(df, text)))  # LEARNED words at most
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def masked(t: str | None, guesser: Guesser) -> str | None:
        both = spans(t, threshold, guesser, blank_threshold)[1]
        if not both:
            return t
        out, at = [], 0
        for _, s, e in both:  # overlapping spans share one mark
            if s >= at:
                out += [t[at:s], mark]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, text):
            own = pa.array([masked(t, shared.value) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([own if n == text else b.column(n) for n in names], names)

    return df.mapInArrow(run, schema)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digests(docs)
