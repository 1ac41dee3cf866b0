"""Periodic runs, centroid clustering and mixing against brute force and SQL on small tables, with nulls, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids, mixing, periodic, queries

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_centroids", "op13_mixing"])
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = db.execute(queries.oracle_sql()[name])
    names, rows = [c[0] for c in want.description], want.fetchall()
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names) and len(rows) > 100
    assert sorted(map(repr, (tuple(r) for r in got.select(*(f"`{c}`" for c in names)).collect()))) == sorted(map(repr, rows))


# periodic runs


def slow_runs(words):
    """(start, length, period), by trying each period at each place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            a = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - a + q >= max(12, 2 * q):
                found.setdefault((a, i - a + q), q)
            i += 1
    return sorted(((a, m, q) for (a, m), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, n, kinds):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n:
            a, p = rng.randrange(n), rng.randint(1, 25)
            for i in range(a + p, min(n, a + rng.randint(p, 7 * p))):
                words[i] = words[i - p]
    return words


def test_runs_are_those_of_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        words = repetitive(rng, rng.randint(0, 130), rng.choice([1, 2, 3, 5, 60]))
        ids = periodic._numbered([str(w).encode() for w in words])
        assert periodic.runs(ids) == slow_runs(words)


def test_lag_counts_of_frequent_and_rare_words_are_exact():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 3, 3000), rng.integers(0, 400, 3000), np.zeros(500, np.int64), rng.zipf(1.3, 4000)):
        ids = np.unique(ids, return_inverse=True)[1]
        want = [0] + [int((ids[q:] == ids[:-q]).sum()) for q in range(1, len(ids) // 2 + 1)]
        assert periodic.lag_counts(ids).tolist() == want


def test_long_texts_of_few_words_take_little_time():
    import time

    rng, began = np.random.default_rng(3), time.time()
    assert periodic.runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    assert periodic.runs(np.arange(600_000) % 150_000) == [(0, 600_000, 150_000)]
    assert len(periodic.runs(rng.integers(0, 2, 100_000))) > 100
    assert time.time() - began < 60


def test_periodic_digests_are_those_of_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{x}é" if x % 2 else f"W{x}" for x in repetitive(rng, rng.randint(0, 90), rng.choice([2, 6, 40]))) for _ in range(300)]
    texts += [None, "", " \n\t", "x", "a b " * 30 + "  c", "\x1c\x1d one\x85two " * 8, "long " * 50_000, "a b c " * 4, "a b c " * 4]
    rows = [(i, t, i, "r") for i, t in enumerate(texts)] + [(None, "z y " * 20, 0, "r"), (7, texts[7], 0, "r"), (7, texts[7], 0, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, _periodic string")
    got = periodic.digests(periodic.find(periodic.planted(docs)))

    def want(doc_id, text):
        w = SPACED.findall(text or "")
        n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = slow_runs(w) if n < 1000 else [(0, n, 1)]
        gone = {i for a, m, q in runs for i in range(a + q, a + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))

    assert Counter(tuple(r) for r in got.collect()) == Counter(want(i, t) for i, t, _, _ in rows)
    assert sum(r.n_runs > 0 for r in got.collect()) > 50
    found = periodic.find(docs)
    assert found.columns == ["doc_id", "text", "_periodic", "n_words", "runs", "collapsed"] and found.filter("doc_id = 7").count() == 3
    assert periodic.digests(periodic.find(periodic.planted(docs.limit(0)))).count() == 0


# centroids


def slow_clusters(rows, dimensions, k, rounds):
    kept = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) and abs(x) < 1e6 for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centres)]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), centres


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_clusters_are_those_of_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 4)) * 4
    rows = [(i, [float(x) for x in middles[i % 12] + rng.normal(size=4) * spread]) for i in range(900)]
    rows += [(1000 + i, [0.25, -0.25, 0.0, 1.0]) for i in range(300)]  # copies
    rows += [(2000 + i, [float(i % 2), float(i % 3), 0.0, 0.0]) for i in range(60)]  # ties
    rows += [(1, rows[1][1]), (None, [0.0, 0.0, 0.0, 0.0]), (5000, None), (5001, []), (5002, [1.0] * 5), (5003, [1.0, None, 0.0, 0.0]), (5004, [float("nan"), 0.0, 0.0, 0.0]), (5005, [float("inf"), 0.0, 0.0, 0.0]), (5006, [0.0, 1e30, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, cluster int").repartition(3)
    want, centres = slow_clusters(rows, 4, 16, 3)
    got, final = centroids.cluster(table, dimensions=4)
    assert final.tolist() == centres
    assert Counter(tuple(r) for r in got.collect()) == want
    total = sum(d * n for (_, _, d), n in want.items())
    digested = centroids.digests(got, final).collect()
    assert len(digested) == sum(want.values()) and {r.inertia for r in digested} == {total}
    for r in digested:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
        assert r.cluster_inertia == sum(d * n for (_, c, d), n in want.items() if c == r.cluster)


def test_few_and_no_vectors(spark):
    table = spark.createDataFrame([(3, [0.5, 1.0]), (4, [0.5, 1.0])], "vec_id long, embedding array<float>")
    got, final = centroids.cluster(table, dimensions=2)
    assert {tuple(r) for r in got.collect()} == {(3, 0, 0), (4, 0, 0)} and final.tolist() == [[32, 64], [32, 64]]
    assert centroids.digests(*centroids.cluster(table.limit(0), dimensions=2)).count() == 0
    assert centroids.digests(*centroids.cluster(table, dimensions=64)).count() == 0


def test_trees_drop_centroids_and_assign_nodes_whole():
    rng = np.random.default_rng(6)
    middles = rng.integers(-2000, 2000, (16, 8))
    points = middles[rng.integers(0, 16, 4000)] + rng.integers(-40, 40, (4000, 8))
    batch = centroids._stored(__import__("pyarrow").array(range(4000)), points)
    decided = list(centroids._decided(batch.to_pylist()[0], middles))
    assert sum(b - a for a, b, _, _ in decided) == 4000
    assert sum(b - a for a, b, node, _ in decided if node >= 0) > 2000
    far = centroids._filtered(points[None].min(1), points[None].max(1), np.ones((1, 16), bool), middles)
    assert far.any()


# mixing


def test_permutations_are_permutations(spark):
    for n in (1, 2, 3, 10, 97, 4096, 5000):
        back = mixing.shuffled(spark.range(n), "x", F.col("id"), F.lit(n), F.lit(5)).orderBy("id").collect()
        assert sorted(r.x for r in back) == list(range(n))
    assert sum(abs(a - b) > 500 for a, b in zip([r.x for r in back], [r.x for r in back][1:])) > 3500  # neighbours part


def reshared(sizes, weights=(5, 2, 1)):
    """Targets by giving the excess to the others until there is none."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2.0 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_takes_what_the_targets_say(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "B", "é", "z", None, "tiny", "none"]
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 7, 60, 900]))), rng.choice(sources[:4] if i % 3 else ["a"])) for i in range(200)]
    rows += [(300, None, "none"), (301, "", "none"), (302, "one\x0btwo\x85 three", "tiny"), (None, "x y", None), (None, "x y", None), (5, rows[5][1], rows[5][2]), (400, "long " * 30_000, "z")]
    rows = [(*r, "k", 0) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, number string, size int")
    placed, mixed = mixing.mix(docs.drop("number", "size"), keep=("text",), block=16, shard=32)
    got = mixing.taken(placed, mixed).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.taken(*mixing.mix(docs.repartition(5), block=16, shard=32)).collect()))
    sizes = defaultdict(int)
    for _, t, s, _, _ in rows:
        sizes[s] += len(SPACED.findall(t or ""))
    target, by_source = reshared(sizes), {r.doc_id: r.source for r in docs.filter("doc_id is not null").collect()}
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = by_source.get(r.doc_id)
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[s] and r.target == pytest.approx(target[s], rel=1e-12)
        taken[s] += r.taken
    assert all(target[s] - 1 < taken[s] <= target[s] for s in sizes)
    # slots are full, but for short and cut blocks, and hold the words of their documents in order
    whole = {}
    for r in mixing.texts(mixed).collect():
        whole[r["shard"], r.slot] = r.text.split(" ")
    assert all(0 <= slot < 32 for _, slot in whole) and sum(map(len, whole.values())) == sum(taken.values())
    assert Counter(map(len, whole.values()))[16] > 0.9 * len(whole)
    for r in mixed.collect():
        assert whole[r["shard"], r.slot][r.begin : r.begin + r.words] == SPACED.findall(r.text)[r.start : r.start + r.words]
    # each shard draws from all large sources
    drawn = {(r["shard"], r.number): r.slots for r in mixing.draws(mixed).collect()}
    full = {s for s, _ in drawn} - {max(s for s, _ in drawn)}
    assert all(sum(n for (s, _), n in drawn.items() if s == x) == 32 for x in full) and all((x, 0) in drawn or (x, 1) in drawn for x in full)


def test_sources_beyond_a_broadcast(spark, monkeypatch):
    rows = [(i, "w " * (i % 40), f"s{i % 5}" if i % 7 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(repr, mixing.taken(*mixing.mix(docs, block=16)).collect()))
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(map(repr, mixing.taken(*mixing.mix(docs, block=16)).collect())) == want


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.taken(*mixing.mix(docs)).collect())) == [(1, 0, 0, 0.0, 0, None), (2, 0, 0, 0.0, 0, None)]
    assert mixing.taken(*mixing.mix(docs.limit(0))).count() == 0
