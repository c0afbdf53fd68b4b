"""Operators on pairs, groups and graphs, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from compare import SMALL, oracle, rows
from pyspark.sql import functions as F

from assayer.llm import components, hosts, mixing, neardup, places, queries, topk


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SMALL).toPandas()) == rows(oracle(queries.ORACLE_SQL[name]))


def shingle_set(t, w):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(ws[i : i + w]) for i in range(max(1, len(ws) - w + 1))) if ws else frozenset()


def brute(texts, w):
    """Smallest reachable id by comparing all pairs."""
    sets = {i: shingle_set(t, w) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j]:
                m = len(sets[i] & sets[j])
                if 100 * m >= 80 * (len(sets[i]) + len(sets[j]) - m):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, share):
    return [rng.choice("xyzuvw") + str(rng.randint(0, 999)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_all_pairs(spark, width):
    rng = random.Random(width)
    texts, n = {}, 0
    for _ in range(6):
        source = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 90))]
        for share in [0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1] * 3:
            words = edited(rng, source, share)
            texts[n] = " ".join(words[: len(words) - rng.choice([0, 0, 0, 2, 5])])
            n += 1
    texts |= {n: "", n + 1: None, n + 2: "one", n + 3: "ONE ", n + 4: "a b", n + 5: "b a"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(df, width=width).collect()}
    assert got == brute(texts, width)


def test_near_duplicate_query_against_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.op4_neardup(spark, SMALL).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(texts, 2).items()}


def test_near_duplicates_odd(odd_documents, no_documents):
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.link(odd_documents, width=2).collect()), key=str)
    assert found == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (5, 5, True), (None, None, True), (6, 1, False)], key=str)
    assert neardup.link(no_documents).count() == 0
    assert sorted((r.doc_id for r in neardup.deduplicated(odd_documents).collect()), key=str) == [1, 2, 3, 4, 5, None]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    order = list(range(60))
    rng.shuffle(order)
    edges = [(a, b) for a, b in zip(order[:30], order[1:30])] + [(order[30], x) for x in order[31:50]] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = [order[:30], order[30:50]]
    assert got == {i: min(g) for g in groups for i in g}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_targets(spark, odd_documents, no_documents):
    rows_ = [(i, "w " * (i % 9), s) for i, s in enumerate(["big"] * 60 + ["mid"] * 20 + ["tiny"] * 2 + [None] * 5)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    got = mixing.mix(df.join(spark.createDataFrame(rows_, "doc_id long, t string, source2 string").select("doc_id", "source2"), "doc_id"), source="source2")
    out = got.join(df.select("doc_id", "source"), "doc_id").toPandas()
    total = out["size"].sum()
    by = out.assign(source=out.source.fillna("~")).groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert by.target.sum() == pytest.approx(total) and by.taken.sum() == total and ((by.taken - by.target).abs() <= 9).all() and (by.target <= 3 * by["size"] + 1e-9).all()
    assert (out.taken <= 3 * out["size"]).all() and (out.taken >= 0).all()
    weights = dict(zip(["big", "mid", "tiny", "~"], (5, 2, 1, 5)))
    free = [s for s in by.index if by.target[s] < 3 * by["size"][s]]
    assert len({round(by.target[s] / weights[s], 6) for s in free}) <= 1
    assert mixing.mix(odd_documents).count() == 8 and mixing.mix(no_documents).count() == 0
    again = mixing.mix(df.repartition(7)).select("doc_id", "taken")
    assert sorted(again.collect()) == sorted(mixing.mix(df).select("doc_id", "taken").collect())


def test_mixed_rows_hold_the_words_taken(spark, odd_documents):
    taken = mixing.mix(odd_documents).agg(F.sum("taken")).first()[0]
    out = mixing.mixed(odd_documents)
    assert out.columns == odd_documents.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.collect()) == taken


def test_the_pipeline_mixes_whole_documents(spark):
    sizes = [("a", 40)] * 3 + [("b", 7)] * 30 + [("c", 200)] * 2
    df = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(n)), "en", s, 1) for i, (s, n) in enumerate(sizes)], "doc_id long, text string, lang string, source string, n_chars long")
    texts = {r.doc_id: r.text for r in df.collect()}
    want = {r.source: r.n for r in mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    out = corpus_pipeline.mix_sources(spark, df, "").collect()
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in out)
    for source, n in want.items():
        assert abs(sum(len(r.text.split()) for r in out if r.source == source) - n) <= dict(sizes)[source] / 2
    assert any(len(r.text) < len(texts[r.doc_id]) for r in mixing.mixed(df).collect())


def test_top_k_of_odd_vectors(spark):
    rng = random.Random(4)
    data = [(i, [rng.gauss(0, 1) * rng.choice([0.1, 1, 9]) for _ in range(6)]) for i in range(300)]
    data += [(300, [0.0] * 6), (350, None), (400, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (450, [float("nan")] * 6), (500, [1.0] * 2), (501, [2.0] * 2), (502, [9.0] * 6), (502, [9.0] * 6), (None, [1.0] * 6), (550, [float("inf")] * 6), (600, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("bucket", F.lit("x"))
    topk.BLOCK_ROWS, topk.QUERY_ROWS, old = 40, 3, (topk.BLOCK_ROWS, topk.QUERY_ROWS)
    try:
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df.filter("vec_id % 50 = 0"), df, 5).collect()}
    finally:
        topk.BLOCK_ROWS, topk.QUERY_ROWS = old
    import math

    import numpy as np

    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:5]
            want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want
    assert topk.search(df.limit(0), df, 5).count() == 0


def test_top_k_of_large_components(spark):
    import numpy as np

    rng = random.Random(6)
    data = [(i, [rng.uniform(-1, 1) * rng.choice([1.0, 16384.0, 3e6]) for _ in range(6)]) for i in range(300)]
    data += [(i, [3e6 + (i % 4) / 256, 16384.0, 0.0, 0.0, 0.0, 1.0]) for i in range(300, 340)] + [(400, [float("inf")] * 6), (401, [-20000.0] + [0.0] * 5)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    topk.BLOCK_ROWS, topk.QUERY_ROWS, old = 40, 3, (topk.BLOCK_ROWS, topk.QUERY_ROWS)
    try:
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df.filter("vec_id % 50 = 0"), df, 5).collect()}
    finally:
        topk.BLOCK_ROWS, topk.QUERY_ROWS = old
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data if np.isfinite(v).all()]
    want = {}
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:5]
            want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want and any(s > 2**53 for _, s in want.values())
    matrix, vector = np.array([[2**40, -(2**40), 3], [2**40, -(2**40) + 1, 0]]), np.array([2**40, 2**40, 5])
    scores = topk.products(matrix, vector)
    assert scores.tolist() == [15, 2**40] and topk.best(scores, np.array([7, 9]), 1).tolist() == [1]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.search(df, spark.createDataFrame([(1, [1e30])], df.schema), 5).collect()


def test_link_graph(spark):
    link = lambda *hs: " ".join(f'<a class="l" href="https://{h}/x">t</a>' for h in hs)
    data = [(1, "http://Bad.net/", link("friend.com")), (2, "https://friend.com/a", link("bad.net", "bad.net")), (3, "http://good.org/fr/1", link("fine.com")), (4, "http://fine.com/?q", None), (5, "http://lone.com", ""), (6, None, None), (7, "no scheme", "x"), (7, "no scheme", "x"), (8, "http://a.example.net/en/q", ""), (9, "http://a.example.net/de/q", "")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in hosts.judge(df).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("bad.net", "/", "net/", "block")
    assert got[2].verdict == "block" and got[2].distrust > 0.8 and got[4].trust > got[4].distrust and got[4].verdict == got[5].verdict == "allow"
    assert (got[6].host, got[6].path, got[6].rule, got[6].verdict) == ("", "", None, "allow")
    assert got[8].rule == "example.net/en/" and got[9].rule == "net/"
    assert hosts.judge(df.limit(0)).count() == 0


def walks(names, edges, seeds):
    """(trust, distrust) of each host from the limits of the walks, by solving for them."""
    import numpy as np

    at = {h: i for i, h in enumerate(names)}
    links = np.zeros((len(names), len(names)))
    for a, b, n in edges:
        links[at[a], at[b]] = n
    out = []
    for m, own in ((links, seeds[0]), (links.T, seeds[1])):
        passed = (m / np.maximum(m.sum(axis=1, keepdims=True), 1)).T
        score = np.linalg.solve(np.eye(len(names)) - 0.85 * passed, 0.15 * own)
        assert score.sum() <= own.sum() + 1e-9  # a walk never gains
        got, most = passed @ score, 0.15 * passed.sum(axis=1)
        out.append(np.maximum(own, np.minimum(np.divide(got, most, out=np.zeros_like(got), where=most > 0), 1)))
    return out


def test_distrust_of_many_linkers_and_long_chains(spark):
    import numpy as np

    names = ["bad.net", "good.org", *(f"l{i}.com" for i in range(20)), *(f"c{i}.com" for i in range(12)), "x.com", "y.com"]
    edges = [(f"l{i}.com", "bad.net", 1) for i in range(20)] + [("c0.com", "bad.net", 3)] + [(f"c{i + 1}.com", f"c{i}.com", 1) for i in range(11)]
    edges += [("x.com", "y.com", 2), ("y.com", "x.com", 1), ("y.com", "bad.net", 1), ("good.org", "l3.com", 1), ("l4.com", "x.com", 3)]
    own = [np.array([float(h == s) for h in names]) for s in ("good.org", "bad.net")]
    trust, distrust = walks(names, edges, own)
    seeds = spark.createDataFrame([(h, float(h == "good.org"), float(h == "bad.net")) for h in names], "host string, trust double, distrust double")
    got = {r.host: r for r in hosts.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, links long")).collect()}
    for i, h in enumerate(names):
        assert abs(got[h].distrust - distrust[i]) < 1e-3 and abs(got[h].trust - trust[i]) < 1e-3
    assert got["l19.com"].distrust == got["c0.com"].distrust == got["l3.com"].trust == 1.0 and abs(got["c1.com"].distrust - 0.85 * 3 / 24) < 1e-9
    link = lambda h: f'<a href="https://{h}/x">t</a>'
    pages = [(i, f"http://l{i}.com/", link("bad.net")) for i in range(20)] + [(20, "http://half.com/", link("bad.net") + link("far.com")), (21, "http://bad.net/", "")]
    verdicts = {r.page_id: r.verdict for r in hosts.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert verdicts == {i: "allow" if i == 20 else "block" for i in range(22)}


@pytest.mark.parametrize("seed", range(4))
def test_linked_pages_in_query_and_sql(spark, tmp_path, seed):
    """Pages that link across hosts, among them rings, hubs and many linkers of one blocked host: the query, its SQL and the limits agree."""
    import numpy as np

    rng = random.Random(seed)
    names = [*(f"bad{i}.net" for i in range(3)), *(f"fine{i}.org" for i in range(3)), *(f"h{i}.com" for i in range(40)), "hub.io"]
    pages = []
    for h in names:
        for _ in range(rng.randint(1, 3)):
            near = rng.sample(names, rng.choice([0, 1, 1, 2, 3])) + [rng.choice(names[:6])] * rng.choice([0, 0, 1, 2]) + ["hub.io"] * rng.choice([0, 0, 0, 1])
            html = " ".join(f'<a href="https://{x}/p">t</a>' for x in (names if h == "hub.io" else near))
            pages.append((len(pages), f"http://{h}/{'fr/' if h.endswith('org') and rng.random() < 0.7 else ''}p", html))
    pages += [(len(pages) + i, f"http://only{i}.com/", '<a href="//bad0.net/">t</a>') for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op9_hosts"](spark, str(tmp_path)).toPandas()
    import duckdb

    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert rows(got) == rows(con.execute(hosts.OP9_SQL).df())
    edges = [(r.src, r.dst, r.links) for r in hosts.host_edges(df).collect()]
    names = sorted({x for a, b, _ in edges for x in (a, b)} | set(got.host))
    seeds = hosts.judged_by_rule(df).groupBy("host").agg(F.avg((F.coalesce("rule_verdict", F.lit("")) == "allow").cast("double")).alias("t"), F.avg((F.coalesce("rule_verdict", F.lit("")) == "block").cast("double")).alias("d")).collect()
    own = [np.array([{r.host: r[c] for r in seeds}.get(h, 0.0) for h in names]) for c in "td"]
    trust, distrust = walks(names, edges, own)
    gap = dict(zip(names, distrust - trust))
    free = got[got["rule"].isna()]
    assert [(r.page_id, r.verdict) for r in free.itertuples() if abs(gap[r.host] - 0.499) > 2e-3] == [(r.page_id, "block" if gap[r.host] > 0.499 else "allow") for r in free.itertuples() if abs(gap[r.host] - 0.499) > 2e-3]
    assert {"block", "allow"} == set(free.verdict) and all(v == "block" for v in free[free.host.str.startswith("only")].verdict)


@pytest.fixture(scope="module")
def seen(spark):
    """What each stage of the pipeline reads and writes, by name."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = places.kept(stage(spark, docs, "/root/testdata/sf0.01"), name)
    return seen


def test_pipeline_stages(spark, seen, odd_documents, no_documents):
    assert all(df.columns == seen["input"].columns for name, df in seen.items() if name != "pieces")
    texts = {r.doc_id: r.text for r in seen["language"].collect()}
    kept = {r.doc_id for r in seen["near_duplicates"].collect()}
    assert kept == {i for i, (_, c) in brute(texts, 5).items() if c == i}
    from assayer.llm.secrets import spans

    assert {r.doc_id for r in seen["secrets"].collect()} == kept
    assert not any(spans(r.text)[0] for r in seen["secrets"].collect())
    assert seen["pieces"].count() == seen["mixing"].count()
    for rows_ in (odd_documents, no_documents):
        rows_ = rows_.select("doc_id", "text", "lang", "source", "n_chars")
        names, texts = rows_.columns, {r.doc_id: r.text for r in rows_.collect()}
        for name, stage in corpus_pipeline.STAGES:
            rows_ = places.kept(stage(spark, rows_, ""), name)
            assert name == "pieces" or rows_.columns == names
            if name == "secrets":
                left = {r.doc_id: r.text for r in rows_.collect()}
        assert left == {i: re.sub("password=abc123def", "[secret]", t) for i, t in texts.items() if t and re.search("[a-z]", t) and i != 6}
        assert rows_.filter("n_tokens <> size(token_ids)").count() == 0 and {r.doc_id for r in rows_.collect()} <= set(left)


def test_pipeline_rows_against_plain_versions(seen):
    before, told = ({r.doc_id: r for r in seen[n].collect()} for n in ("input", "language"))
    assert {i: r.text for i, r in told.items()} == {i: r.text for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
    labelled = [i for i in told if before[i].lang is not None]
    assert sum(told[i].lang == before[i].lang for i in labelled) >= 0.98 * len(labelled)

    unique, masked = ({r.doc_id: r for r in seen[n].collect()} for n in ("near_duplicates", "secrets"))
    assert {i: unique[i] for i in unique} == {i: told[i] for i in unique}
    base = r"(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9+/_.=-]{6,})|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}"
    sign = r"(?i)pass|pwd|secret|token|key|credential|auth|bearer|login|pin|client|://"
    touched = 0
    assert masked.keys() == unique.keys()
    for i, r in masked.items():
        held = re.findall(base, unique[i].text)
        assert not re.search(base, r.text) and r.n_chars == len(r.text) and (r.lang, r.source) == (unique[i].lang, unique[i].source)
        if held or re.search(sign, unique[i].text):
            touched += r.text != unique[i].text
            around = [re.escape(part) for part in r.text.split("[secret]")]
            assert re.fullmatch("(?s:.+?)".join(around), unique[i].text) and (not held or "[secret]" in r.text)
        else:
            assert r.text == unique[i].text
    assert touched

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    mixed = seen["mixing"].collect()
    times = {}
    for r in mixed:
        assert r == masked[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3
    whole, targets = {}, {}
    for r in masked.values():
        whole.setdefault(r.source, []).append(size(r.text))
    sources = sorted(whole, key=lambda x: (x is None, x))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(sources)}
    left, free = sum(map(sum, whole.values())), set(whole)
    while full := {x for x in free if left * weight[x] / sum(weight[y] for y in free) > 3 * sum(whole[x])}:
        targets |= {x: 3 * sum(whole[x]) for x in full}
        left, free = left - sum(targets[x] for x in full), free - full
    targets |= {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
    for x in sources:
        assert abs(sum(size(r.text) for r in mixed if r.source == x) - targets[x]) <= max(whole[x])

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = seen["pieces"].collect()
    assert sorted((r.doc_id, r.text) for r in pieces) == sorted((r.doc_id, r.text) for r in mixed)
    for r in {r.doc_id: r for r in pieces}.values():
        ids = library.encode(r.text)
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_members_of_one_component_never_meet(spark):
    """Two groups of thousands around one centre: what they don't share is dropped before any rows meet."""
    size = 2000
    sets = [(0, list(range(100)))] + [(g * size + i, [*range(60), *range(1000 * g, 1000 * g + 39), 10_000 + g * size + i]) for g in (1, 2) for i in range(size)]
    sets = spark.createDataFrame([(i, len(m), m) for i, m in sets], "id long, n long, members array<long>")
    around = sets.filter("id > 0").select(F.lit(0).cast("long").alias("centre"), "id", "n", F.floor(F.col("id") / size).alias("component"))
    assert neardup.across(around, sets, 80).count() == 0  # 60 shared of 140
    close = spark.createDataFrame([(0, list(range(50)), 0), (1, list(range(100)), 1), (2, [*range(90), *range(200, 210)], 2), (3, [*range(50), *range(300, 350)], 3)], "id long, members array<long>, component long").withColumn("n", F.size("members").cast("long"))
    found = neardup.across(close.filter("id > 0").select(F.lit(0).cast("long").alias("centre"), "id", "n", "component"), close, 80).collect()
    assert [(r.a, r.b) for r in found] == [(1, 2)]


def test_two_large_groups_that_share_rare_shingles_do_not_meet(spark):
    """10,000 sets each around one centre, all with the same rare members besides; one pair across is similar and is found."""
    size = 10_000
    ids = spark.range(2 * size + 2).withColumn("group", F.when(F.col("id") >= 2 * size, 2).otherwise(F.floor(F.col("id") / size)))
    span = lambda a, b: F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))
    centre, rare = span(0, 19), span(100, 105)  # in the centre's set, and in both groups but not there
    own = F.when(F.col("group") == 0, span(200, 211)).when(F.col("group") == 1, span(300, 311)).otherwise(span(400, 411))
    edits = F.when(F.col("group") < 2, F.array(F.col("id") * 2 + 10_000, F.col("id") * 2 + 10_001)).otherwise(F.array(F.col("id") + 10_000_000))
    sets = ids.select("id", "group", F.array_sort(F.concat(centre, rare, own, edits)).alias("members"))
    sets = sets.select("id", F.size("members").cast("long").alias("n"), "members", F.when(F.col("group") == 2, F.col("id")).otherwise(F.col("group") * size).alias("component"))
    around = sets.select(F.lit(-1).cast("long").alias("centre"), "id", "n", "component")
    assert [(r.a, r.b) for r in neardup.across(around, sets.select("id", "n", "members"), 80).collect()] == [(2 * size, 2 * size + 1)]


@pytest.mark.parametrize("seed", range(3))
def test_meeting_across_components_against_all_pairs(spark, seed):
    """Subsets and supersets of a centre with members of their own, in several sizes and components: no similar pair is missed."""
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        base = rng.sample(range(60), rng.choice([20, 30, 45])) if rng.random() < 0.5 or not rows else list(rng.choice(rows)[2])
        own = set(base) | {rng.randint(100, 130) for _ in range(rng.choice([0, 2, 5]))}
        own -= set(rng.sample(sorted(own), min(len(own) - 1, rng.choice([0, 1, 3]))))
        rows.append((i, len(own), sorted(own), rng.randint(0, 40)))
    sets = spark.createDataFrame(rows, "id long, n long, members array<long>, component long")
    around = sets.select(F.lit(-1).cast("long").alias("centre"), "id", "n", "component")
    got = {(r.a, r.b) for r in neardup.verified(neardup.across(around, sets, 80), sets, 80).collect()}
    want = {(i, j) for i, _, a, c in rows for j, _, b, d in rows if i < j and c != d and 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))}
    assert got == want and want


def test_recall_of_all_true_pairs(spark):
    """Large clusters of edited copies: every pair at 0.8 or more ends in one component."""
    rng = random.Random(11)
    texts, n = {}, 0
    for _ in range(3):
        source = [f"w{rng.randint(0, 900)}" for _ in range(120)]
        for _ in range(90):
            texts[n] = " ".join(edited(rng, source, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05])))
            n += 1
    got = {r.doc_id: r.component_id for r in neardup.link(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    sets = {i: shingle_set(t, 5) for i, t in texts.items()}
    pairs = [(i, j) for i in texts for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    caught = sum(got[i] == got[j] for i, j in pairs) / len(pairs)
    print(f"recall of {len(pairs)} pairs: {caught:.4f}")
    assert caught == 1.0 and {i: c for i, (_, c) in brute(texts, 5).items()} == got


def test_what_is_kept_can_be_cleared(spark, tmp_path, monkeypatch):
    path, files = places._hadoop(spark, str(tmp_path))  # without a scheme: the default file system's
    assert files.makeQualified(path).toString() == f"file:{tmp_path}" and places.shared_root(spark).startswith("file:///")
    monkeypatch.setattr(places, "shared_root", lambda _: f"file://{tmp_path}")
    table = places.kept(spark.range(5).toDF("n"), "numbers")
    assert table.count() == 5 and list(tmp_path.glob("assayer-*/numbers-*"))
    places.clear(spark)
    assert not list(tmp_path.glob("assayer-*"))
