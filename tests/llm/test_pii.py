"""Personal data: base spans against plain regular expressions, and the added spans."""

import random
import re

from tidemark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [(2 * d - 9 if d > 4 else 2 * d) if i % 2 else d for i, d in enumerate(reversed(digits))]
            fine = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    rng = random.Random(7)
    parts = ["a", "B.", "@", "x@y.co", ".", "..", "-", "1", "22", "255", "256", "0001", " ", "  ", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "+1 (437) 555-0689", "é", "🙂", "_", "%", "", "", "\n", "1.2.3.4", "token = \"", "5157452173657494"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(1500)]
    return [*out, None, "", "a@b.c.d..e@f.g", "a@b.com_x@y.com", "1.2.3.4.5.6.7.8", "9" * 30000, "1 " * 20000, "a@" + "b." * 20000, "x." * 20000, "+1" + " 2" * 9000]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    given = texts()
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(given)], "doc_id long, text string, kind string")
    got = {r.doc_id: [tuple(s) for s in r.pii_spans] for r in pii.find(df).collect()}
    assert len(got) == len(given)
    for i, t in enumerate(given):
        assert [s for s in got[i] if s[0] in PLAIN] == brute(t), t


def test_added_spans_are_disjoint_and_found(spark):
    secret = "token = \"2e78d4bdec68f18b395a94d7e68821fb27738004\""
    rows = [(i, f"On {i} we saw {secret} there", "en") for i in range(30)] + [(99, "a: bcdefghijklmnopqrst and more", "en")] * 30
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 60
    for r in got:
        assert [s.kind for s in r.pii_spans] == (["secret"] if r.doc_id < 30 else [])
    start = rows[5][1].index('"2e')
    assert next((s.start, s.end) for r in got if r.doc_id == 5 for s in r.pii_spans) == (start, start + 42)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.co, 10.0.0.1.", [("email", 2, 8), ("ip", 10, 18)]), (2, None, []), (3, "abcdef", [("x", 1, 4), ("y", 3, 5)])], "doc_id long, text string, pii_spans array<struct<kind:string,start:int,end:int>>")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "é [EMAIL], [IP].", 2: None, 3: "a[X]f"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digests(pii.find(df)).count() == 0


def test_native(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = pii.digests(pii.find(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_estimates_are_those_of_every_candidate_by_itself():
    rng = random.Random(9)
    counts = [{"kind": "number", "shape": a, "gazetteer": b, "context": c, "long": d, "n": rng.randint(1, 40)} for a in (0, 1) for b in (0, 1) for c in (0, 1) for d in (0, 1)]
    votes = [tuple(r[f] for f in pii.LABELERS) for r in counts for _ in range(r["n"])]
    prior, hit = 0.5, {1: [0.8] * 3, 0: [0.2] * 3}
    for _ in range(pii.ROUNDS):
        post = []
        for v in votes:
            like = {c: (prior if c else 1 - prior) for c in (0, 1)}
            for c in (0, 1):
                for x, h in zip(v, hit[c]):
                    like[c] *= h if x else 1 - h
            post.append(like[1] / (like[0] + like[1]))
        for c, base in ((1, 0.8), (0, 0.2)):
            weight = [p if c else 1 - p for p in post]
            hit[c] = [(sum(w for w, v in zip(weight, votes) if v[j]) + 2 * base) / (sum(weight) + 2) for j in range(3)]
        prior = (sum(post) + 1) / (len(post) + 2)
    each = dict(zip(votes, post))
    for row, p in zip(counts, pii.estimate(counts)):
        assert abs(p - each[tuple(row[f] for f in pii.LABELERS)]) < 1e-9
    weights = pii.train(counts)
    assert set(weights) == set(pii.ADDED) and any(weights["number"]) and not any(weights["secret"])
