"""License scans against a plain search of all windows, on whole, edited and neighbouring licenses."""

import random
import re

from tidemark.llm import licenses

LOW = {i: i + 32 for i in range(65, 91)}
OF = dict(licenses.TEMPLATES)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(text, given):
    """Identifiers and the largest containment of what matches, without signatures."""
    w, matches = words(text), []
    for license_id, template in {(i, " ".join(words(t))) for i, t in given if i is not None and words(t)}:
        own = template.split()
        s = min(len(own), licenses.SHORT) if len(own) < licenses.LONG_FROM else licenses.LONG
        n = len(own) - s + 1
        keys, step = {tuple(own[i : i + s]) for i in range(n)}, -(-n // 2)
        for window in range(0, max(1, len(w) - s + 1), step):
            held = [(p, tuple(w[p : p + s])) for p in range(window, min(window + 2 * n, len(w) - s + 1)) if tuple(w[p : p + s]) in keys]
            found = len({k for _, k in held})
            if held and found >= licenses.CONTAINED * len(keys):
                matches.append((license_id, {p for p, _ in held}, 2 * found - len(keys), found / len(keys)))
    kept = []
    for license_id, places, score, containment in matches:
        rivals = {}
        for other, there, theirs, _ in matches:
            if other != license_id and theirs > score:
                rivals.setdefault(other, set()).update(places & there)
        if not any(2 * len(shared) >= len(places) for shared in rivals.values()):
            kept.append((license_id, containment))
    return ",".join(sorted({i for i, _ in kept})), max((c for _, c in kept), default=None)


def edited(rng, text, times):
    own = text.split()
    for _ in range(times):
        own[rng.randrange(len(own))] = rng.choice(["Acme", "shall", "foo bar", ""])
    return " ".join(own)


def test_matches_are_those_of_a_plain_search(spark):
    rng = random.Random(21)
    noise = lambda n: " ".join(rng.choice(["the", "license", "of", "software", "under", "ka", "lo", "mi"]) for _ in range(n))
    rows = [(None, None), (1, ""), (2, "MIT"), (2, "Licensed under the MIT License"), (None, "Licensed under the MIT License")]
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        rows.append((100 + i, f"{noise(rng.randint(0, 30))} {edited(rng, text, len(text.split()) // 40)} {noise(rng.randint(0, 30))}"))
    for i in range(20):
        pair = rng.sample(licenses.TEMPLATES, 2)
        rows.append((300 + i, " ".join(edited(rng, t, rng.randint(0, 2)) for _, t in pair) + noise(9)))
    got = licenses.label(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = [(d, *brute(t, licenses.TEMPLATES)) for d, t in rows]
    assert sorted(((r.doc_id, r.licenses, r.containment) for r in got), key=repr) == sorted(want, key=repr)


def test_licenses_are_told_apart(spark):
    cc0, mpl = OF["CC0-1.0"], next(t for i, t in licenses.TEMPLATES if i == "MPL-2.0")
    gpl = lambda v: f"This work is licensed under the GNU General Public License, version {v}."
    texts = [
        ("CC0-1.0,MPL-2.0", mpl + " " + cc0.rsplit(" ", 1)[0] + " thing"),
        ("MIT", next(t for i, t in licenses.TEMPLATES if i == "MIT").replace("Software", "Program", 1)),
        ("MIT-0", next(t for i, t in licenses.TEMPLATES if i == "MIT-0")),
        ("BSD-2-Clause", next(t for i, t in licenses.TEMPLATES if i == "BSD-2-Clause")),
        ("BSD-3-Clause", next(t for i, t in licenses.TEMPLATES if i == "BSD-3-Clause")),
        ("GPL-2.0", gpl(2)),
        ("GPL-3.0", gpl(3)),
        ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
        ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
        ("", "permission to use the license of this software"),
    ]
    got = {r.doc_id: r.licenses for r in licenses.label(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [want for want, _ in texts]


def test_given_templates(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "nothing here")], "doc_id long, text string")
    given = spark.createDataFrame([("A", "alpha beta gamma delta"), ("A", "alpha beta gamma delta"), (None, "alpha"), ("B", None), ("C", " .. "), ("D", "x")], "license_id string, text string")
    got = {r.doc_id: (r.licenses, r.containment) for r in licenses.label(docs, given).collect()}
    assert got == {1: ("A", 1.0), 2: ("", None)}
    assert {r.n_licenses for r in licenses.label(docs, given.limit(0)).collect()} == {0}
