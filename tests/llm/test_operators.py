"""Corpus operators against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, decontaminate, jaccard, licenses, lm, pii, ppm, quality, sharding, toxicity
from tidemark.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LOW = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "ka lo mi ter un sa vor ne pi dra ghu él".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def table(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, None, "s") for i, t in rows], "doc_id long, text string, score double, node string")


def odd():
    return [(900, None), (901, ""), (902, " \n"), (903, "x"), (904, "One  two"), (None, "no id here at all today"), (905, "long " * 30000)]


def test_words_merged_together_are_those_of_the_library():
    rng = random.Random(3)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        own = bpe.Codec(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    syllables = ["tion", "que", "ai", "ón", "ñ", "heit", "st", "a", "aa", "zu", "日", "é", "Th"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 9))) for _ in range(3000)]
    texts = [None, "", " ", *(" ".join(w + rng.choice(["", "", ",", "\n", " "]) for w in rng.choices(words, k=60)) for _ in range(100))]
    alone = []
    one_by_one, own.encode_piece = own.encode_piece, lambda piece: alone.append(piece) or one_by_one(piece)
    own.learn(texts)
    assert not alone and len(own.spaced) > 1000
    for w, ids in own.spaced.items():
        assert np.frombuffer(ids, np.int32).tolist() == library.encode_ordinary(" " + w)
    for t in texts:
        assert own.encode(t).tolist() == library.encode_ordinary(t or "")
    known = [p for p in alone if p[:1] == b" " and p[1:].decode().isalpha() and len(p) <= bpe.SHORT and p not in own.ranks]
    assert not known  # all of them were merged together before


def test_bpe_is_that_of_the_library_and_decodes(spark):
    rng = random.Random(1)
    alphabet = " \n\t\x1c\x85'sédt12²½ab日本語🙂!?-_　 "
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))) for i in range(400)] + odd() + [(906, "a" * 20000), (907, "xyzzy" * 4000)]
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(table(spark, rows), RANKS, public_tokenizers.PATTERN)
    got = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).select("doc_id", "text", "token_ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.token_ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.digests(bpe.decode(bpe.encode(table(spark, rows).limit(0), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def test_decontamination_is_that_of_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 12, 10, 9, 3, 1, 40])] + [(7, None), (8, ""), (None, "null item text is not used"), (1, prose(rng, 15))]
    rows = odd()
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items[:7])[1])
            a = rng.randrange(len(w))
            parts += [rng.choice([" ", ", "]).join(w[a : a + rng.randint(1, 25)]).upper(), prose(rng, rng.randint(0, 9))]
        rows.append((i, " ".join(parts)))
    rows += rows[10:14]
    windows = {}
    for item, text in items:
        w = words(text)
        for p in range(max(1, len(w) - 9) if w and item is not None else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add(str(item))
    want = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for g, ids in windows.items():
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    found |= ids
        want.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.digests(decontaminate.mark(table(spark, rows), benchmark)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert decontaminate.mark(table(spark, rows), benchmark.limit(0)).filter("contaminated").isEmpty()
    assert decontaminate.mark(table(spark, []), benchmark).isEmpty()
    clean = decontaminate.clean(table(spark, rows), benchmark)
    assert clean.count() == sum(not w[-1] for w in want) and clean.columns == ["doc_id", "text", "score", "node"]


def shingle_set(text):
    w = SPACED.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_components_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # hot buckets in several blocks
    rng = random.Random(3)
    rows, common = odd(), prose(rng, 30)
    for size in (6, 20, 60, 150, 400):
        for _ in range(3):
            base = prose(rng, size).split()
            for _ in range(rng.choice([1, 3, 24])):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    copy[rng.randrange(size)] = prose(rng, 1)
                rows.append((len(rows) * 3 % 997 + 2000, " ".join(copy)))
    rows += [(5000 + i, f"{common} {prose(rng, 3)}") for i in range(40)] + [(6000 + i, "same again and again and again") for i in range(30)] + rows[20:24]
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    want = [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]
    got = [tuple(r)[:3] for r in jaccard.join(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert jaccard.join(table(spark, [])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


def test_sharding(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 80))) for i in range(1500)] + [(3000 + i, "copy of a hot text") for i in range(700)] + odd()[:4] + [(1, "again"), (1, "again")]
    got = sharding.shard(table(spark, rows), 8).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    size = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(size) <= 1.05 * sum(size) / 8
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.shard(table(spark, []), 8).count() == 0


def test_sharding_spreads_hot_rows_whatever_their_ids(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randint(1, 40))) for i in range(500)] + [(None, "the same text again")] * 800 + [(7, "another hot text")] * 700
    got = sharding.shard(table(spark, rows), 8).collect()
    for measure in (lambda r: r["size"], lambda r: 1):
        shards = Counter()
        for r in got:
            shards[r.shard] += measure(r)
        assert len(shards) == 8 and max(shards.values()) <= 1.1 * sum(shards.values()) / 8
    words = {zlib.crc32((t or "").encode()): len((t or "").split()) for _, t in rows}
    tokens = Counter()
    for r in got:
        tokens[r.shard] += words[r.text_crc32]
    assert max(tokens.values()) <= 1.1 * sum(tokens.values()) / 8
    one = sharding.shard(table(spark, rows), 1)
    assert {r.shard for r in one.collect()} == {0} and one.count() == len(rows)
    with pytest.raises(ValueError):
        sharding.shard(table(spark, rows), 0)


def test_copies_go_by_their_text_whatever_their_ids(spark):
    a, b, c = ("word " * 3 + f"{x} the quick brown fox jumps over lazy dogs {x}" for x in "abc")
    rows = [(1, a), (2, a), (2, "something else altogether that nobody has"), (None, b), (None, b), (3, c), (3, c), (4, None), (4, None), (5, ""), (6, c), (None, c)]
    docs = table(spark, rows).withColumnsRenamed({"score": "row", "node": "text_key"})
    got = jaccard.dedupe(docs)
    assert got.columns == docs.columns
    want = [(1, a), (2, "something else altogether that nobody has"), (None, b), (3, c), (4, None), (4, None), (5, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert jaccard.dedupe(docs.limit(0)).isEmpty()


def test_signatures_are_shared_by_linked_sets():
    rng = np.random.default_rng(15)
    new = lambda n: rng.integers(1, 1 << 63, n).astype(np.uint64)
    for size in [3, 8, 40, 127, 128, 129, 150, 171, 256, 257, 300, 341, 512, 700] * 3:
        x = np.sort(new(size))
        for add, gone in ((size // 3, 0), (0, size // 4), (size // 7, size // 7)):
            y = np.sort(np.concatenate([rng.permutation(x)[gone:], new(add)]))
            if not jaccard.linked(x, y):
                continue
            had, least = ({}, {}), ({}, {})
            for numbers, band, shared, signature, owner in jaccard.families(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])):
                for i, k, n in zip(numbers, band, shared):
                    had[i][k], least[i][k] = set(signature[owner == i].tolist()), n
            both = had[0].keys() & had[1].keys()
            assert both and all(len(had[0][k] & had[1][k]) >= max(least[0][k], least[1][k]) >= 1 for k in both)


def test_columns_of_any_name_pass_through(spark):
    names = ["_email", "_candidates", "pii_base", "pii_spans", "row", "text_key", "_key", "_doc", "own", "n_tokens"]
    rows = [(1, "write to a@b.co now", *names), (None, None, *names), (2, "", *names), (1, "again 10.0.0.1", *names)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    benchmark = spark.createDataFrame([(1, "again 10.0.0.1")], "item_id long, text string")
    cleaned = pii.clean(docs)
    assert cleaned.columns == docs.columns
    assert sorted(map(tuple, cleaned.collect()), key=repr) == sorted([(1, "write to [EMAIL] now", *names), (None, None, *names), (2, "", *names), (1, "again [IP]", *names)], key=repr)
    left = decontaminate.clean(docs, benchmark)
    assert left.columns == docs.columns and sorted((r.text for r in left.collect()), key=repr) == sorted([None, "", "write to a@b.co now"], key=repr)
    assert {tuple(r)[2:] for r in jaccard.dedupe(docs).collect()} == {tuple(names)}
    with pytest.raises(ValueError):
        bpe.encode(docs, RANKS, public_tokenizers.PATTERN, out_col="n_tokens")


def test_joins_beyond_the_broadcast_limits(spark, monkeypatch):
    rng = random.Random(16)
    items = [(i, prose(rng, 14)) for i in range(5)]
    rows = [(i, f"{prose(rng, 9)} {items[i % 5][1]} {prose(rng, 5)}") for i in range(20)] + odd()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    few = sorted(map(str, decontaminate.mark(table(spark, rows), benchmark).collect()))
    licensed = [(i, f"{prose(rng, 9)} {licenses.TEMPLATES[i][1]} {prose(rng, 5)}") for i in range(12)] + odd()
    found = sorted(map(str, licenses.label(table(spark, licensed)).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(licenses, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(jaccard, "BROADCAST_DOCS", 0)
    assert sorted(map(str, decontaminate.mark(table(spark, rows), benchmark).collect())) == few
    assert sorted(map(str, licenses.label(table(spark, licensed)).collect())) == found
    assert jaccard.dedupe(table(spark, [*rows, *rows])).count() == len(rows) + 3  # those without words stay


def test_native_operators_have_no_python(spark):
    docs = table(spark, [(1, "Licensed under the MIT License.")])
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    for df in (licenses.scan(docs), licenses.label(docs), decontaminate.mark(docs, benchmark), decontaminate.clean(docs, benchmark), pii.clean(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(12, size=3000)] + 0.3 * rng.standard_normal((3000, 16))).astype(np.float32)
    x[500:1500] = x[500]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9000, None, 1), (9020, [0.0] * 16, 1), (9040, [float("nan")] * 16, 1), (9060, [None] * 16, 1), (9080, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.search(df, lambda v: v % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    products, hit, total = x.astype(float) @ x.astype(float).T, 0, 0
    assert sorted(got) == list(range(0, 3000, 20))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(f[2] == pytest.approx(products[q, f[1]], abs=1e-9) and f[1] != q for f in found)
        order = [i for i in np.lexsort((np.arange(3000), -products[q].round(9))) if i != q][:20]
        hit, total = hit + len(set(order) & {f[1] for f in found}), total + 20
    assert hit / total >= 0.9
    few = ann.search(df.filter("vec_id < 3"), lambda v: v % 20 == 0)
    assert few.count() == 2 and ann.search(df.limit(0), lambda v: v % 20 == 0).count() == 0


def test_language_model(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 60)).title()) for i in range(300)] + odd()
    out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2, F.lit(False))
    texts = {d: SPACED.findall((t or "").translate(LOW)) + [""] for d, t in rows}
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    count = Counter(w for d, ws in texts.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    results = []
    for frequent in (1 << 18, 20):  # all tokens broadcast, or most of them joined
        got = {r.doc_id: r for r in lm.score(table(spark, rows), out, frequent=frequent).collect()}
        assert len(got) == len(rows)
        for d, ws in texts.items():
            r = got[d]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(count[w] > 0 for w in ws), n)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
            assert r.score < 0
        results.append(got)
    assert all(results[0][d].score == pytest.approx(results[1][d].score, rel=1e-7) for d in texts)
    assert lm.score(table(spark, []), F.lit(False)).count() == 0


class Docs:
    """Stands for documents and keeps the function that a worker is given."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self

    def groupBy(self, *keys):  # noqa: N802
        return self

    def agg(self, *sums):
        return self


def test_signatures_are_packed_whole():
    rng, parts, n = np.random.default_rng(8), 51, 300_000
    index = {k: i for i, k in enumerate(rng.integers(-1 << 62, 1 << 62, 2000).tolist())}
    node = rng.integers(0, len(index), n).astype(np.uint32)
    # some signatures are had by many sets
    sig = np.where(np.arange(n) % 10 == 0, rng.integers(1, 40, n), rng.integers(1, 1 << 62, n)).astype(np.uint64)
    keys, nodes, signatures = list(index), [node], [sig]
    batches = list(jaccard._pack(index, nodes, signatures, parts))
    want, seen = Counter(), Counter()
    for i in np.argsort(sig, kind="stable").tolist():
        hot = seen[int(sig[i])] > jaccard.COLD
        seen[int(sig[i])] += 1
        key = keys[node[i]]
        want[(key % (1 << 64) if hot else int(sig[i])) % parts, key, int(sig[i]) >> 16, hot] += 1
    got = Counter()
    for batch in batches:
        for r in batch.to_pylist():
            key, short, hot = jaccard._unpacked(r["payload"])
            got.update(zip([r["part"]] * len(key), key.tolist(), short.tolist(), [k < hot for k in range(len(key))], strict=True))
    assert got == want


def test_signatures_in_bounded_memory(spark):
    """A worker packs the signatures of some hundred thousand at a time, however many its partition has."""
    rng = np.random.default_rng(9)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (20_000, 6))])
    batches = [pa.RecordBatch.from_pydict({"text": [" ".join(rng.choice(words, 2000)) for _ in range(20)]}) for _ in range(40)]
    jaccard._signatures(docs := Docs(), 51, "text")
    assert sum(b.num_rows for b in docs.run(iter(batches[:1]))) == 51  # libraries are loaded
    tracemalloc.start()
    packed = sum(b.num_rows for b in docs.run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert packed >= 51
    assert peak < 30e6, peak


def test_language_model_counts_in_bounded_memory(spark, monkeypatch):
    """Workers add up the counts of slices while they read, and hand them on in small batches, the same sums whatever they hold."""
    rng = np.random.default_rng(4)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (20_000, 6))])
    batches = [pa.RecordBatch.from_pydict({"text": [" ".join(rng.choice(words, 10_000)) for _ in range(10)], "training": [i % 3 > 0] * 10}) for i in range(18)]
    lm.count(docs := Docs())
    sums = []
    tracemalloc.start()
    for batch in docs.run(iter(batches)):
        assert batch.num_rows <= 50_000
        sums.append([int(np.sum(batch.column(c).to_numpy())) for c in ("total", "known")])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6, peak
    # each word and its space, and the end of each text, as bytes and as tokens
    assert np.sum(sums, 0).tolist() == [n * (10_000 * 7 + 1 + 10_000 + 1) for n in (180, 120)]
    few = [b.slice(0, 1) for b in batches[:4]]
    added = []
    for loose, counted in ((1 << 30, 1 << 30), (1, 1), (1, 1 << 30)):
        monkeypatch.setattr(lm, "LOOSE_KEYS", loose)
        monkeypatch.setattr(lm, "COUNTED_KEYS", counted)
        got = Counter()
        for batch in docs.run(iter(few)):
            for r in batch.to_pylist():
                got[r["gram"], r["key"], "total"] += r["total"]
                got[r["gram"], r["key"], "known"] += r["known"]
        added.append(got)
    assert added[0] == added[1] == added[2]


def test_trie_probabilities_sum_to_one():
    tokens = [b"the", b"then", b"that", b"a", b"an", b"", b"x\xff"]
    ends = np.cumsum([0, *map(len, tokens)])
    trie = ppm.Trie(*ppm.ngrams(np.frombuffer(b"".join(tokens), np.uint8), ends, np.ones(len(tokens))))

    def log10(token):
        return trie.log10(np.frombuffer(token, np.uint8), np.array([0, len(token)]))[0]

    def after(prefix, symbol):
        symbols = np.frombuffer(b" " + prefix + bytes([symbol]), np.uint8)
        n = len(symbols)
        return 10 ** trie.coded(symbols, np.arange(n), np.where(np.arange(n) < n - 1, 1, 0), 2)[0]

    assert all(log10(t) < 0 for t in tokens) and log10(b"the") > log10(b"thz") > -40
    for prefix in (b"", b"t", b"th", b"the", b"zz", b"an"):
        assert sum(after(prefix, s) for s in range(256)) == pytest.approx(1, abs=1e-9)


def test_quality_and_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    rows, labels = odd(), []
    for i in range(700):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        text = prose(rng, 80).capitalize() + ". " + prose(rng, 40) + "."
        if not good:
            text = rng.choice([" | ".join(text.split()), text.upper().replace(" ", "!! "), " ".join(w for w in text.split() for _ in range(9))])
        if toxic:
            text += f" {prose(rng, 3)} you are a grumbelfop {prose(rng, 2)}. {prose(rng, 4)} snarkwit idiot."
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    docs, marks = table(spark, rows).drop("score"), spark.createDataFrame([*labels, (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    truth = {d: (q, t) for d, q, t in labels}
    for module, column, at in ((quality, 0, 0.9), (toxicity, 1, 0.95)):
        got = module.classify(docs, marks).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert len(held) > 50 and sum(r.predicted == truth[r.doc_id][column] for r in held) >= at * len(held)
        assert module.classify(docs.limit(0), marks).count() == 0
        assert module.classify(docs, marks.limit(0)).count() == len(rows)


def test_quality_votes_are_those_of_all_pairs(spark):
    rng = random.Random(12)
    rows, labels = odd(), []
    for i in range(160):
        good = rng.random() < 0.6
        text = prose(rng, rng.randint(5, 60)).capitalize() + "."
        rows.append((i, text if good else rng.choice([text.upper(), " | ".join(text.split()), text + " 12 34 56 " * 9])))
        labels.append((i, int(good)))
    rows += [(900 + i, " ".join(f"x{'Y' * (j % 40)}{j}" for j in range(i, i + 900))) for i in range(2)]  # more terms than the space has
    labels += [(900, 1), (901, 0), (3, None), (500, 1)]
    docs, marks = table(spark, rows).drop("score"), spark.createDataFrame(labels, "doc_id long, quality int")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    truth = {}
    for d, q in labels:
        if q is not None and not held(d):
            truth[d] = max(q, truth.get(d, 0))
    learned = sorted(((d, t) for d, t in rows if d in truth), key=lambda x: x[0])
    bags = [quality.terms(t) for _, t in learned]
    often = sorted(Counter(t for bag in bags for t in bag).items(), key=lambda x: (-x[1], x[0]))[: quality.TERMS]
    names, idf = [t for t, _ in often], np.array([math.log1p(len(bags) / n) for _, n in often])
    vector = lambda bag: np.array([math.sqrt(bag.get(t, 0) / sum(bag.values())) for t in names]) * idf
    basis = np.linalg.svd(np.array([vector(b) for b in bags]), full_matrices=False)[2][: quality.DIMENSIONS]
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    near = [unit(basis @ vector(b)) for b in bags]
    for r in quality.classify(docs, marks).collect():
        options = [t for d, t in rows if d == r.doc_id]
        votes = []
        for text in options:
            mine = unit(basis @ vector(quality.terms(text)))
            order = sorted(range(len(near)), key=lambda i: -float(near[i] @ mine))[: quality.NEIGHBOURS]
            weight = [max(0.0, min(1.0, float(near[i] @ mine))) ** quality.SHARPNESS + 1e-6 for i in order]
            votes.append(sum(w * truth[learned[i][0]] for w, i in zip(weight, order)) / sum(weight))
        assert any(r.score == pytest.approx(v, abs=0.05) for v in votes) and r.held_out == held(r.doc_id)


def test_composed_grammar_is_all_paths_of_its_parts():
    rng = random.Random(13)
    parts = [part() for part in toxicity.PARTS]

    def paths(states, symbol, factor=1.0, done=()):
        if not (rest := parts[len(done) :]):
            yield done, symbol, factor
            return
        for to, out, f in rest[0].arcs.get((states[len(done)], symbol), ()):
            yield from paths(states, out, factor * f, (*done, to))

    def best(states, clause):
        if not clause:
            return 0.0 if all(q in part.final for q, part in zip(states, parts)) else -math.inf
        (symbol, weight), rest = clause[0], clause[1:]
        found = [(weight * f if out == "E" else 0.0) + best(to, rest) for to, out, f in paths(states, symbol)]
        return max(found, default=-math.inf)

    for _ in range(300):
        clause = [(s, {"I": rng.choice([1.0, 2.5]), "H": 2.0}.get(s, 0.0)) for s in rng.choices(toxicity.SYMBOLS, [4, 3, 1, 3, 2, 1, 1, 6], k=rng.randint(1, 7))]
        assert toxicity.Grammar.clause(clause) == pytest.approx(best(tuple(p.start for p in parts), clause))
    long = [("I", 2.0), *[("O", 0.0)] * 5000, ("T", 0.0)]
    assert toxicity.Grammar.clause(long) == toxicity.Grammar.clause([("I", 2.0), *[("O", 0.0)] * 9, ("T", 0.0)]) == 2.0


def test_grammar_reads_clauses_not_words():
    g = toxicity.Grammar({"idiot ": 3.0})
    weight = lambda t: g.features(t)[0]
    assert weight("I kill time") == 0 < weight("they kill you") < weight("they will kill you")
    assert weight("you are not nice but an idiot") > weight("you are not a nice idiot")
    assert weight("idiot. you") < weight("idiot you")
    assert weight("ide\u0301e") == weight("id\u00e9e") == 0


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"idiot ": 3.0, "snark": 2.0})
    plain, aimed, negated, reported = (g.features(t)[0] for t in ("an idiot came", "you idiot came", "he is not an idiot", "Ann said an idiot came"))
    assert aimed > plain > negated and plain > reported and g.features("a calm day")[0] == 0
    assert g.features("snarkling")[0] > 0 and g.features("kill time")[0] == 0 < g.features("I kill you")[0]


def test_licenses(spark):
    rng = random.Random(8)
    rows = odd() + [(i, f"{prose(rng, rng.randint(0, 50))}\n{licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1].upper()} {prose(rng, rng.randint(0, 30))}") for i in range(60)] + [(200 + i, prose(rng, 60)) for i in range(40)]
    got = {r.doc_id: r for r in licenses.label(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(60):
        assert licenses.TEMPLATES[i % len(licenses.TEMPLATES)][0] in got[i].licenses.split(",") and got[i].containment == 1.0
    assert all(got[d].n_licenses == 0 for d, _ in rows if d is None or d >= 200)
    assert licenses.label(table(spark, [])).count() == 0


def test_language_model_keeps_every_ngram(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(1, 40))) for i in range(80)] + [(80, "日本語 text"), (81, "日本 und ünd")] + odd()[:6]
    streams = {d: b" " * 5 + b"".join(w.encode() + b" " for w in SPACED.findall((t or "").translate(LOW))) + b" " for d, t in rows}
    held = {d for d in streams if d is not None and d % 4 == 0}
    seen = {}
    for d, s in streams.items():
        for i in range(5, len(s)) if d not in held else ():
            for k in range(6):
                seen.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def coded(context, symbol):
        p, gone = 1.0, set()
        for k in range(5, -1, -1):
            here = {s: n for s, n in seen.get(context[5 - k :], {}).items() if s not in gone}
            if symbol in here:
                return p * here[symbol] / (sum(here.values()) + len(here))
            if here:
                p *= len(here) / (sum(here.values()) + len(here))
            gone |= here.keys()
        return p / (256 - len(gone))

    truth = {d: sum(math.log10(coded(s[i - 5 : i], s[i])) for i in range(5, len(s))) for d, s in streams.items()}
    out = F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False))
    for frequent in (1 << 18, 20, 0):
        got = {r.doc_id: r.score for r in lm.score(table(spark, rows), out, frequent=frequent).collect()}
        assert got == {d: pytest.approx(t, rel=1e-9) for d, t in truth.items()}
    counted = lm.count(table(spark, rows).select(F.coalesce("text", F.lit("")).alias("text"), (~out).alias("training"))).cache()
    whole, cut = ({r.key: r.code for r in lm.code(counted, at_once=n).collect()} for n in (1 << 20, 10))
    assert len(whole) == len({s[i - 5 : i + 1] for s in streams.values() for i in range(5, len(s))}) and whole == pytest.approx(cut)
    blank = {r.doc_id: r.score for r in lm.score(table(spark, rows), F.lit(True)).collect()}
    assert blank[80] == pytest.approx(-(len(streams[80]) - 5) * math.log10(256))


def test_language_model_sees_the_order_of_words(spark):
    order = "ab cd ef gh ij kl".split()
    rows = [(i, " ".join(order)) for i in range(20)] + [(100, " ".join(order)), (101, " ".join(order[::-1]))]
    got = {r.doc_id: r for r in lm.score(table(spark, rows), F.col("doc_id") >= 100).collect()}
    assert got[100].base_score == pytest.approx(got[101].base_score) and got[100].score > got[101].score + 5


def test_quality_reads_a_long_token_to_its_end():
    plain, junk = "日本語の文章，続く。" * 400, "x9X/+7=qQ%" * 400
    bags = [quality.terms(plain + plain), quality.terms(plain + junk)]
    assert bags[0] != bags[1]  # equal in their first 4,000 characters
    assert quality.terms("日本語" * 3000 + "!x9") == quality.terms("a!a9")
    learned = [quality.terms(t * n) for n in range(1, 40) for t in (plain, junk)]
    space = quality.Space([*Counter(t for bag in learned for t in bag).items()], len(learned))
    space.learn(space.rows(learned), np.array([1, 0] * 39))
    scores = space.scores([quality.terms(plain + junk * k) for k in (0, 1, 50)])
    assert scores[0] > scores[1] or scores[1] > scores[2]
    assert scores[0] > 0.7 > scores[2]


def test_nearest_neighbours_are_as_many_as_there_are(spark, monkeypatch):
    monkeypatch.setattr(ann.Forest, "enough", lambda *_: 1)  # one leaf, which may hold few vectors
    x = np.random.default_rng(3).standard_normal((15, 16))
    for n, vectors in ((15, x), (60, np.repeat(x[:2], 30, axis=0))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        got = Counter(r.query_id for r in ann.search(df, lambda v: v % 5 == 0).collect())
        assert got == {q: min(20, n - 1) for q in range(0, n, 5)}


def test_nearest_neighbours_of_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect() if r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in ann.search(df, lambda v: v % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        near = {int(ids[i]) for i in np.argsort(-score, kind="stable")[:20]}
        hit, total = hit + len(near & got[int(ids[q])]), total + len(near)
    assert hit / total >= 0.9
