"""Codebooks, fingerprints and alignments against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from compare import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm import alignments, codebooks, simhash

# Codebooks


def lloyd(vectors, rounds=6):
    """Plain integers: codes, errors and codebooks of (id, vector) rows."""
    rows = [[int(np.floor(4096 * float(x))) for x in v] for _, v in sorted(vectors)]
    size = len(rows[0]) // 8
    parts = [[r[p * size : (p + 1) * size] for r in rows] for p in range(8)]
    books = [[list(x) for x in own[:16]] for own in parts]
    gap = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (gap(x, book[e]), e))
    for _ in range(rounds):
        for p in range(8):
            held = defaultdict(list)
            for x in parts[p]:
                held[nearest(x, books[p])].append(x)
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else b for e, b in enumerate(books[p])]
    codes = [[nearest(parts[p][i], books[p]) for p in range(8)] for i in range(len(rows))]
    errors = [sum(gap(parts[p][i], books[p][codes[i][p]]) for p in range(8)) for i in range(len(rows))]
    return ["".join(f"{c:02x}" for c in x) for x in codes], errors, books


@pytest.mark.parametrize("n", [3, 16, 200, 900])
def test_codebooks_against_plain_lloyd(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(5, 16))
    vectors = [(i, (centres[i % 5] + rng.normal(scale=0.02 if i % 3 else 0.5, size=16)).astype(np.float32).tolist()) for i in range(n)]
    vectors += [(n + i, vectors[0][1]) for i in range(20)]  # ties
    df = spark.createDataFrame([(i, v, i % 3 or None, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    found, books = codebooks.compress(df)
    got = {r.vec_id: r for r in codebooks.with_label_error(found).collect()}
    codes, errors, want = lloyd(vectors)
    assert books.tolist() == want
    by_label = Counter()
    for (i, _), e in zip(sorted(vectors), errors):
        by_label[i % 3 or None] += e
    assert [(got[i].code, got[i].error, got[i].label_error) for i, _ in sorted(vectors)] == [(c, e, by_label[i % 3 or None]) for (i, _), c, e in zip(sorted(vectors), codes, errors)]


def test_trees_assign_nodes_whole_and_as_brute_force_does():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-20, 20, (400, 4)) + 3000 * c for c in range(5)] + [rng.integers(-3000, 15000, (500, 4))]).astype(np.int32)
    book = np.stack([np.full(4, 3000 * c % 15000) for c in range(5)] + [np.full(4, 6000)] + [rng.integers(0, 9000, 4) for _ in range(10)])
    order = codebooks.grown(points, codebooks.LEAF)
    own = points[order]
    tree, entries = codebooks.levels(own, codebooks.LEAF), codebooks.Entries(book)
    depths, nodes, _, leaf, candidates = codebooks.descend(tree, entries)
    assert len(nodes) > 10 and len(leaf) < 16 * (1 << len(tree) - 1)  # bounds do prune
    sums, codes = codebooks.assign(own, tree, entries)
    gap = ((own[:, None].astype(np.int64) - book[None]) ** 2).sum(axis=2)
    assert codes.tolist() == gap.argmin(axis=1).tolist()
    assert sums[:, 0].tolist() == np.bincount(codes, minlength=16).tolist()
    assert all((sums[e, 1:] == own[codes == e].sum(axis=0)).all() for e in range(16))


def test_codebooks_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [float(i) for i in range(8)]
    rows = [(None, good), (1, None), (2, []), (3, [None] * 8), (4, [nan] * 8), (5, [inf] * 8), (6, good[:7]), (7, good), (7, good), (8, good * 2), (9, [-x for x in good])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<double>, label string")
    found, books = codebooks.compress(df)
    got = sorted((r.vec_id, r.error, r.label_error) for r in codebooks.with_label_error(found).collect())
    assert got == [(7, 0, 0), (7, 0, 0), (9, 0, 0)] and books.shape == (8, 3, 1)
    found, books = codebooks.compress(df.limit(0))
    assert codebooks.with_label_error(found).collect() == [] and codebooks.listed(books) == ""
    with pytest.raises(Exception, match="beyond"):
        codebooks.compress(spark.createDataFrame([(1, [1e6] * 8, 1)], "vec_id long, embedding array<double>, label int"))


# Fingerprints


def plain_print(text, width=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + width]).encode(), 42) for i in range(max(1, len(ws) - width + 1))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closed(prints):
    """The smallest id reachable over pairs at a distance of 2 or less, by all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op12_simhash(spark, SMALL).collect()}
    prints = {r.doc_id: plain_print(r.text) for r in docs.collect()}
    want = closed(prints)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


@pytest.mark.parametrize("seed", range(4))
def test_links_of_planted_fingerprints(spark, seed):
    """Clouds in which distances of 0 to 4 bits abound, in one segment and in both; many share a segment."""
    rng = random.Random(seed)
    prints, n = {}, 0
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 2, 3, 4])):
                x ^= 1 << b
            prints[n := n + 1] = x
    low = rng.getrandbits(32)
    for _ in range(60):
        prints[n := n + 1] = rng.getrandbits(32) << 32 | low
    signed = {i: x - (1 << 64 if x >> 63 else 0) for i, x in prints.items()}
    nodes = spark.createDataFrame(list(signed.items()), "node long, print long").groupBy("print").agg(F.min("node").alias("node"))
    edges = [(r.a, r.b) for r in simhash.links(nodes).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in edges)
    first = {}
    for i, x in sorted(prints.items()):
        first.setdefault(x, i)
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {i: find(first[x]) for i, x in prints.items()} == closed(prints)


def test_fingerprints_of_odd_rows(spark, odd_documents, no_documents):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.linked(odd_documents).collect()}
    prints = {r.doc_id: f"{plain_print(r.text):016x}" for r in odd_documents.collect()}
    want = {(i, p, None if i is None else {3: 2, 6: 1}.get(i, i)) for i, p in prints.items()}
    assert got == want and simhash.linked(odd_documents).count() == odd_documents.count()
    assert simhash.linked(no_documents).collect() == []
    same_id = spark.createDataFrame([(2, "a b c"), (5, "a b c"), (5, "x y z"), (9, "x y z")], "doc_id long, text string")
    assert {r.component_id for r in simhash.linked(same_id).collect()} == {2}


@pytest.mark.parametrize("size", [1, 7, 64])
def test_shingles_cross_pieces(size):
    text = "One two\tthree  four\x0bfive ü six\n" * 5
    whole, cut = (np.concatenate(list(simhash.shingle_hashes(text, 3, 42, s))) for s in (1 << 20, size))
    assert whole.tolist() == cut.tolist()


# Alignments

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ALPHABET = alignments.byte_alphabet()


def plain_alignment(texts):
    """By the libraries on whole texts and all pairs of tokens."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    raw_a = lambda i: bytes(ALPHABET[c] for c in a.id_to_token(i))
    raw_b = lambda i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode()
    out, linked, holders = [], [], Counter()
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if b"".join(map(raw_a, ids_a)) != (" " + (t or "")).encode() or b"".join(map(raw_b, ids_b)) != (" " + (t or "")).encode():
            ids_a, ids_b = [], []
        ends_a, ends_b = np.cumsum([len(raw_a(i)) for i in ids_a]).tolist(), np.cumsum([len(raw_b(i)) for i in ids_b]).tolist()
        cuts = [0, *sorted(set(ends_a) & set(ends_b))]
        groups = [f"{','.join(str(i) for i, e in zip(ids_a, ends_a) if lo < e <= hi)}|{','.join(str(i) for i, e in zip(ids_b, ends_b) if lo < e <= hi)}" for lo, hi in zip(cuts, cuts[1:])]
        links = [(i, j) for i, s, e in zip(ids_a, [0, *ends_a], ends_a) for j, s2, e2 in zip(ids_b, [0, *ends_b], ends_b) if s < e2 and s2 < e]
        linked.append(links)
        holders.update(set(links))
        out.append([len(ids_a), len(ids_b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""])
    best = Counter()
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    return [(*row[:4], sum(holders[x] == best[x[0]] for x in links), sum(holders[x] for x in links), row[4]) for row, links in zip(out, linked)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_against_the_libraries(spark):
    rng = random.Random(3)
    parts = ["the", "The", " ", "  ", "\n", "\t", "don't", "naïve", "über", "12345", "<|endoftext|>", "</s>", "▁", "...", "日本語", "😀", "aaa", "aaaaaaa", " ", "　", "x=1;", "\r\n", "Straße", "\x00", "-", "_foo_", "'s"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    texts += [None, "", " ", "  ", "a", "a ", "\n", "▁", " the", "the the the"] + texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignments.align(df, *PATHS).collect()}
    assert got == dict(enumerate(plain_alignment(texts)))


def test_alignment_of_the_small_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text or "") < 20_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignments.align(df, *PATHS).collect()}
    assert got == dict(zip(texts, plain_alignment(list(texts.values()))))


def test_alignment_of_odd_rows(spark, odd_documents, no_documents):
    found = alignments.align(odd_documents, *PATHS).collect()
    assert len(found) == odd_documents.count()
    assert {(r.n_a, r.n_links, r.count_sum, r.groups_sha256) for r in found if r.doc_id in (2, 3)} == {(0, 0, 0, "")}
    assert {r.doc_id: r.n_a > 0 for r in found if r.doc_id is None or r.doc_id == 4} == {None: True, 4: True}
    assert alignments.align(no_documents, *PATHS).collect() == []
