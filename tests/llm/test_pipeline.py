"""The pipeline, each stage against brute force on a small table, and run() against its stages."""

import base64
import math
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken

from test_operators import shingle_set, words
from test_pii import brute
from tidemark.llm import pii, quality
from tidemark.llm.common import table, written

SF = "/root/testdata/sf0.001"


def votes(rows, labels):
    """The quality of each text: cosine votes of all labelled ones that aren't held out, one by one."""
    marks = {r.doc_id: r.quality for r in labels if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    learned = sorted((d, t) for d, t in rows if d in marks)
    bags = [quality.terms(t) for _, t in learned]
    often = sorted(Counter(t for bag in bags for t in bag).items(), key=lambda x: (-x[1], x[0]))[: quality.TERMS]
    idf = np.array([math.log1p(len(bags) / n) for _, n in often])
    vector = lambda bag: np.array([math.sqrt(bag.get(t, 0) / sum(bag.values())) for t, _ in often]) * idf
    basis = np.linalg.svd(np.array([vector(b) for b in bags]), full_matrices=False)[2][: quality.DIMENSIONS]
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    near, out = np.array([unit(basis @ vector(b)) for b in bags]), {}
    for d, t in rows:
        cosine = near @ unit(basis @ vector(quality.terms(t)))
        order = np.argsort(-cosine, kind="stable")[: quality.NEIGHBOURS]
        weight = np.clip(cosine[order], 0, 1) ** quality.SHARPNESS + 1e-6
        out[d] = float((weight * [marks[learned[i][0]] for i in order]).sum() / weight.sum())
    return out


def apart(rows):
    """The ids left when of linked texts only that with the smallest id stays."""
    ids, sets = [d for d, _ in rows], [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return set(least.values())


def clean(rows, items):
    windows = {tuple(w[p : p + 10]) for w in map(words, items) if w for p in range(max(1, len(w) - 9))}
    sizes = {len(g) for g in windows}
    return {d for d, t in rows if not any(tuple(w[p : p + n]) in windows for w in [words(t)] for n in sizes for p in range(len(w) - n + 1))}


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    labels, items = table(spark, SF, "labels").collect(), [r.text for r in table(spark, SF, "benchmark").collect()]
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    docs = written(stages["quality"](spark, docs, SF), "test-quality")
    score, kept = votes(rows, labels), [(r.doc_id, r.text) for r in docs.collect()]
    assert docs.columns == columns
    # scores are of single precision, so those at the very limit may go either way
    assert {d for d, _ in kept} ^ {d for d, s in score.items() if s >= 0.7} <= {d for d, s in score.items() if abs(s - 0.7) < 0.02}

    docs = written(stages["near_copies"](spark, docs, SF), "test-copies")
    rows, kept = kept, [(r.doc_id, r.text) for r in docs.collect()]
    assert docs.columns == columns and len(kept) == len({d for d, _ in kept}) and {d for d, _ in kept} == apart(rows)

    docs = written(stages["decontamination"](spark, docs, SF), "test-decontamination")
    rows, kept = kept, [(r.doc_id, r.text) for r in docs.collect()]
    assert docs.columns == columns and {d for d, _ in kept} == clean(rows, items)

    spans = {r.doc_id: r.pii_spans for r in pii.find(docs).collect()}
    docs = written(stages["personal_data"](spark, docs, SF), "test-personal")
    rows, kept = kept, [(r.doc_id, r.text) for r in docs.collect()]
    assert docs.columns == columns and [r.n_chars for r in docs.collect()] == [len(t or "") for _, t in kept]
    for d, t in rows:
        assert set(brute(t)) <= {tuple(s) for s in spans[d]}
        want, at = "", 0
        for kind, start, end in sorted(spans[d], key=lambda s: (s[1], s[2], s[0])):
            if start >= at:
                want += t[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert dict(kept)[d] == want + t[at:]

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(stages["tokens"](spark, docs, SF).collect())
    for r in got:
        assert list(r.token_ids) == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids) and r.decodes
    assert len(got) == len(kept) and 0.5 * 200 < len(got) < 200
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == got


def test_stages_on_odd_rows(spark):
    long = "many words of a very long text " * 9000
    rows = [(1, None, 5), (None, "", 6), (2, "Some words here.", 7), (2, "Some words here.", 7), (3, long, 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            assert set(docs.columns) <= set(out.columns)
            n = out.count()
            assert n <= given.count() and (name in ("quality", "near_copies") or n == given.count())
            if name == "near_copies" and n:
                assert n == len(rows) - 1  # the repeated row
            if name == "tokens" and n:
                tokens = next(c for c in out.columns if c.endswith("token_ids"))
                assert {(r.n_tokens, len(r[tokens]) > 0) for r in out.filter("doc_id = 2").collect()} == {(7, True)}
