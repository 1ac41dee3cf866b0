"""A corpus mixed from its sources to target weights, in DataFrame functions only.

The words of each source, document after document, are packed into blocks of fixed length. A
source's target is its weighted part of the whole, capped at MOST times what the source has; the
excess goes to the others. The target makes a number of slots, each of which takes one block;
the last one of a source is cut, so that the source gives its target to the word.

Slot k of a source takes block P(k), where P is a pseudorandom permutation of the source's block
numbers, another one for each pass over the source; so a pass takes each block at most once, and no
document exceeds the number of passes. One more permutation, of all slots, deals them to output
shards of fixed length. Thereby the numbers of blocks that a shard gets from each source are a
multinomial draw given the totals: drawn for each shard alone, they would miss the targets of small
sources by some percent and exceed the cap of those that reach it.

Permutations alternate two steps that permute any range of numbers: x -> (x * prime + key) mod n, with
a prime that doesn't divide n, and a swap-or-not round, in which x and its mirror image (key - x) mod n
change places if a hash of the larger one says so. Each row computes its own value, without sorting or
lists. A source's last block, if it is short, leads each pass. Slots and blocks meet by a join on
(source, block), whose keys are spread evenly however large a source is.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Words of a block; slots of an output shard; rounds of a permutation.
BLOCK, SHARD, ROUNDS = 128, 4096, 6
#: Weights of the sources in order, repeating; the mix's size as a multiple of all words; how often a source may be taken at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Parts into which the documents of a source are packed side by side; slots that are made together.
PARTS, CHUNK = 4096, 4096
#: Sources' names, in bytes, up to which their table is broadcast.
SMALL = 4 << 20
#: Arithmetic of the hashes: a prime below 2^31, so that products fit into 64 bits.
PRIME, SEED = (1 << 31) - 1, 13


def _primes(n: int, below: int = 1 << 26) -> list[int]:
    """The n largest primes below a bound; a number of a range up to 2^36 times one of them fits into 64 bits."""
    out, x = [], below - 1
    while len(out) < n:
        if all(x % k for k in range(3, int(x**0.5) + 1, 2)):
            out.append(x)
        x -= 2
    return out


def _keys(rounds: int = ROUNDS) -> list[tuple[int, int, int, int, int]]:
    """For each round two primes, the second for ranges that the first divides, and three factors."""
    rng, primes = random.Random(SEED), _primes(rounds + 1)
    return [(primes[i], primes[i + 1], *(rng.randrange(1 << 20, PRIME) for _ in range(3))) for i in range(rounds)]


def shuffled(df: DataFrame, name: str, x: Column, n: Column, salt: Column) -> DataFrame:
    """``df`` with ``name``, the place of ``x`` among the numbers below ``n`` (at most 2^36) after a pseudorandom permutation, one for each ``salt``.

    Each round is a projection of its own, so that all run as compiled code.
    """
    df = df.withColumns({name: x.cast("long"), "_n": F.greatest(n, F.lit(1)).cast("long"), "_salt": salt.cast("long") % PRIME})
    for p, q, a, b, c in _keys():
        df = df.withColumns({"_key": (F.col("_salt") * a + b) % PRIME, name: (F.col(name) * F.when(F.col("_n") % p == 0, q).otherwise(p) + F.col("_salt") * b % PRIME) % F.col("_n")})
        df = df.withColumn("_mirror", F.pmod(F.col("_key") - F.col(name), F.col("_n")))
        larger = F.greatest(name, "_mirror")
        bit = F.shiftright((larger % PRIME * c + F.col("_key")) % PRIME, 15).bitwiseAND(F.lit(1))
        df = df.withColumn(name, F.when(bit == 1, F.col("_mirror")).otherwise(F.col(name)))
    return df.drop("_n", "_salt", "_key", "_mirror")


def n_words(text: Column) -> Column:
    """Words between spaces and the characters \\x09 to \\x0D; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source of ``sized`` (source, size): its number in order, size, weight and target, the last in words and not rounded.

    A target is the smaller of most * size and level * weight, for the one level at which targets
    add up to the share of all words: there it ends, if the excess goes to the others again and again.
    """
    # a row per source: few, so one task may order them
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("number", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("_cap", F.col("source_size") * most)
    # in the order in which sources reach their caps: what earlier ones leave, and the weights that share it
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "number")
    earlier, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_at": F.row_number().over(order),
        "_rest": F.sum("source_size").over(whole) * share - F.coalesce(F.sum("_cap").over(earlier), F.lit(0)),
        "_weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)),
    })
    open_ = F.col("_rest") * F.col("weight") < F.col("_cap") * F.col("_weights")
    rows = rows.withColumn("_first", F.min(F.when(open_, F.struct("_at", "_rest", "_weights"))).over(whole))
    level = F.col("_first._rest") * F.col("weight") / F.col("_first._weights")
    target = F.when(F.col("_at") >= F.col("_first._at"), level).otherwise(F.col("_cap").cast("double"))
    return rows.select("source", "number", "source_size", "weight", target.alias("target"))


def slotted(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``targets`` with full and tail, the number of full blocks and the words of a last, short one; blocks, both; slots; cut, the words of the last slot if it is cut; and first, the slots of sources before."""
    size, words = F.col("source_size"), F.floor("target")
    rows = sources.filter(size > 0).withColumns({"full": F.floor(size / block), "tail": F.pmod(size, F.lit(block)), "_passes": F.floor(words / size), "_rest": F.pmod(words, size)})
    # the pass that isn't whole: its first slot is the short block, if there is one
    lead = F.col("tail") > 0
    after = F.when(lead, F.col("_rest") - F.col("tail")).otherwise(F.col("_rest"))
    more = F.greatest(F.ceil(after / block), F.lit(0))
    rows = rows.withColumns({"blocks": F.col("full") + F.when(lead, 1).otherwise(0), "_some": F.when(F.col("_rest") > 0, more + F.when(lead, 1).otherwise(0)).otherwise(0)})
    cut = F.when(after <= 0, F.col("_rest")).otherwise(after - (more - 1) * block)
    rows = rows.withColumns({"slots": F.col("_passes") * F.col("blocks") + F.col("_some"), "cut": F.when(F.col("_some") > 0, cut)})
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.coalesce(F.sum("slots").over(upto), F.lit(0))).drop("_passes", "_rest", "_some")


def _salt(number: Column, passed: Column) -> Column:
    return number * MOST + passed + 1


def drawn(slotted_: DataFrame, total: int, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per slot: shard and slot, its place in the mix; number and block, what it takes; take, how many words of it.

    ``total`` is the number of all slots.
    """
    rows = slotted_.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))))
    rows = rows.repartition(max(8, total >> 18), "number", "_chunk")  # by number, as AQE would join the few rows to one task
    rows = rows.withColumn("_k", F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least(F.col("slots"), (F.col("_chunk") + 1) * CHUNK) - 1)))
    passed, within = F.floor(F.col("_k") / F.col("blocks")), F.pmod(F.col("_k"), F.col("blocks"))
    lead = F.when(F.col("tail") > 0, 1).otherwise(0)
    rows = rows.withColumn("_within", within - lead)
    rows = shuffled(rows, "block", F.col("_within"), F.col("full"), _salt(F.col("number"), passed))
    rows = rows.withColumn("block", F.when(F.col("_within") < 0, F.col("full")).otherwise(F.col("block")))
    length = F.when(F.col("_within") < 0, F.col("tail")).otherwise(block)
    rows = rows.withColumn("take", F.when((F.col("_k") == F.col("slots") - 1) & F.col("cut").isNotNull(), F.col("cut")).otherwise(length))
    rows = shuffled(rows, "_place", F.col("first") + F.col("_k"), F.lit(total), F.lit(0))
    return rows.select(F.floor(F.col("_place") / shard).alias("shard"), F.pmod("_place", F.lit(shard)).cast("int").alias("slot"), "number", "block", "take")


def _part(doc_id: Column, size: Column) -> Column:
    _, _, a, b, c = _keys()[0]
    return F.pmod((F.pmod(F.coalesce(doc_id, F.lit(0)), F.lit(PRIME)) * a + size % PRIME * c) % PRIME * b % PRIME, F.lit(PARTS))


def packed_words(sized: DataFrame, sources: DataFrame, broadcast: bool) -> DataFrame:
    """``sized`` with number, source_size and target of its source, and at, the place of its first word among those of the source.

    Documents follow one another by a hash of doc_id and size, then by both; parts of a source are
    numbered side by side and begin where the parts before end.
    """
    facts = sources.select(F.col("source").alias("_source"), "number", "source_size", "target")
    rows = sized.join(F.broadcast(facts) if broadcast else facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_part", _part(F.col("doc_id"), F.col("size")))
    parts = rows.groupBy("number", "_part").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("number").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("number", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("number", "_part").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(parts, ["number", "_part"]).withColumn("at", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.drop("_part", "_before")


def joined(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: per slot the stretches of documents that it takes, by the columns of both tables; start and words within the document, begin within the slot."""
    rows = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    base = F.col("block") * block
    rows = rows.withColumns({"begin": F.greatest(F.col("at"), base) - base, "_end": F.least(F.col("at") + F.col("size"), base + block) - base})
    # neither side has a bound, so none is broadcast, however small its estimate is
    rows = rows.join(slots.hint("merge"), ["number", "block"])
    rows = rows.withColumns({"words": F.least("_end", "take") - F.col("begin"), "start": base + F.col("begin") - F.col("at")})
    return rows.filter("words > 0").drop("_end", "take")


def mix(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), block: int = BLOCK, shard: int = SHARD, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in their source, and the mix as stretches of them.

    The first table has doc_id, source, size (words), the columns ``keep``, number, source_size,
    target and at; the second has those and shard, slot, block, begin, start and words. A null source
    is a source like others and the last one. Null and empty texts have no words and are in no slot;
    repeated rows and null ids are documents of their own. An empty table gives two empty ones, a
    table without words an empty mix. Every run over the same rows gives the same mix, up to rows
    that agree in doc_id, source and size. Only the number of slots and of sources pass through
    the driver.
    """
    own = [F.col(f"`{c}`") for c in keep if c not in ("doc_id", "source")]
    sized = written(docs.select("doc_id", "source", n_words(F.col(f"`{text_col}`")).alias("size"), *own), "sized")
    sources = written(targets(sized, weights, share, most), "sources")
    small = (sources.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64).alias("n")).first().n or 0) <= SMALL
    placed = written(packed_words(sized, sources, small), "placed")
    slots = slotted(sources, block)
    total = slots.agg(F.sum("slots").alias("n")).first().n or 0
    # written, so that no filter of the join is pushed through the rounds of the permutations, each of which would repeat the one before
    return placed, joined(placed, written(drawn(slots, max(1, total), block, shard), "slots"), block)


def texts(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The words of each slot of a mix that keeps the text, joined by one space: shard, slot, text. A slot has BLOCK words at most."""
    words = F.filter(F.split(F.col(f"`{text_col}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = mixed.select("shard", "slot", "begin", "start", F.col("words").alias("_n"), words.alias("_words"))
    rows = rows.select("shard", "slot", "begin", F.array_join(F.slice("_words", (F.col("start") + 1).cast("int"), F.col("_n").cast("int")), " ").alias("text"))
    parts = rows.groupBy("shard", "slot").agg(F.array_sort(F.collect_list(F.struct("begin", "text"))).alias("_parts"))
    return parts.select("shard", "slot", F.array_join(F.transform("_parts", lambda p: p["text"]), " ").alias("text"))


def draws(mixed: DataFrame) -> DataFrame:
    """How many slots each shard has of each source."""
    return mixed.groupBy("shard", "number").agg(F.count_distinct("slot").alias("slots"))


def taken(placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per document how many of its words the mix takes, repeats counted, and the first shard that has some."""
    sums = mixed.groupBy(F.col("number").alias("_number"), F.col("at").alias("_at")).agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
    # a document without words begins where the next one does, but takes nothing
    same = (F.col("number") == F.col("_number")) & (F.when(F.col("size") > 0, F.col("at")) == F.col("_at"))
    return placed.join(sums, same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_shard")


def _turns(name: str, source: str, x: str, n: str, salt: str) -> str:
    """Common table expressions that end in ``name``: ``source`` with v, the value of ``shuffled``."""
    steps, now = [f"{name}_0 AS (SELECT *, CAST({x} AS BIGINT) AS v, CAST(greatest({n}, 1) AS BIGINT) AS vn, CAST({salt} AS BIGINT) AS vs FROM {source})"], f"{name}_0"
    for i, (p, q, a, b, c) in enumerate(_keys()):
        key, turned = f"(vs * {a} + {b}) % {PRIME}", f"(v * (CASE WHEN vn % {p} = 0 THEN {q} ELSE {p} END) + vs * {b} % {PRIME}) % vn"
        following = name if i == ROUNDS - 1 else f"{name}_{i + 1}"
        steps.append(f"{following} AS (SELECT * EXCLUDE (m, y) REPLACE (CASE WHEN ((greatest(v, m) % {PRIME} * {c} + y) % {PRIME} >> 15) & 1 = 1 THEN m ELSE v END AS v) FROM (SELECT *, ((y - v) % vn + vn) % vn AS m FROM (SELECT * REPLACE ({turned} AS v), {key} AS y FROM {now})))")
        now = following
    return ",\n".join(steps)


def _oracle(block: int = BLOCK, shard: int = SHARD) -> str:
    _, _, a, b, c = _keys()[0]
    return rf"""WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number, source_size * {MOST} AS cap FROM s0),
s2 AS (SELECT *, CASE number % {len(WEIGHTS)} {' '.join(f'WHEN {i} THEN {w}' for i, w in enumerate(WEIGHTS))} END AS weight FROM s1),
s3 AS (SELECT *, row_number() OVER o AS p, (sum(source_size) OVER ())::DOUBLE * {SHARE}::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
  (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS weights FROM s2 WINDOW o AS (ORDER BY cap::DOUBLE / weight, number)),
lv AS (SELECT min(p) AS p, arg_min(rest, p) AS rest, arg_min(weights, p) AS weights FROM s3 WHERE rest * weight < cap * weights),
s AS (SELECT source, number, source_size, CASE WHEN s3.p >= lv.p THEN lv.rest * weight / lv.weights ELSE cap::DOUBLE END AS target FROM s3, lv),
b0 AS (SELECT *, source_size // {block} AS whole, source_size % {block} AS tail, CAST(floor(target) AS BIGINT) // source_size AS passes, CAST(floor(target) AS BIGINT) % source_size AS part FROM s WHERE source_size > 0),
b1 AS (SELECT *, CASE WHEN tail > 0 THEN 1 ELSE 0 END AS lead_, part - tail AS behind FROM b0),
b2 AS (SELECT *, whole + lead_ AS blocks, greatest((behind + {block - 1}) // {block}, 0) AS more FROM b1),
b3 AS (SELECT *, CASE WHEN part > 0 THEN more + lead_ ELSE 0 END AS extra FROM b2),
b AS (SELECT number, blocks, whole, tail, lead_, passes * blocks + extra AS slots, CASE WHEN extra > 0 THEN CASE WHEN behind <= 0 THEN part ELSE behind - (more - 1) * {block} END END AS cut,
  coalesce(sum(passes * blocks + extra) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, sum(passes * blocks + extra) OVER () AS total FROM b3),
k0 AS (SELECT *, unnest(range(slots)) AS k FROM b),
{_turns('k1', 'k0', 'k % blocks - lead_', 'whole', f'number * {MOST} + k // blocks + 1')},
k2 AS (SELECT number, CASE WHEN k % blocks < lead_ THEN whole ELSE v END AS block, first + k AS place, total, CASE WHEN k = slots - 1 AND cut IS NOT NULL THEN cut WHEN k % blocks < lead_ THEN tail ELSE {block} END AS take FROM k1),
{_turns('k', 'k2', 'place', 'total', '0')},
q0 AS (SELECT row_number() OVER () AS r, d.doc_id, d.size, s.number, s.source_size, s.target, ((((coalesce(d.doc_id, 0) % {PRIME}) + {PRIME}) % {PRIME} * {a} + d.size % {PRIME} * {c}) % {PRIME} * {b} % {PRIME}) % {PARTS} AS part FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY number ORDER BY part, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun FROM q0),
w AS (SELECT *, unnest(range(begun // {block}, (begun + size - 1) // {block} + 1)) AS block FROM q WHERE size > 0),
t AS (SELECT r, sum(n) AS taken, min(shard) AS first_shard FROM (SELECT r, k.v // {shard} AS shard, least(least(begun + size, block * {block} + {block}) - block * {block}, take) - (greatest(begun, block * {block}) - block * {block}) AS n FROM w JOIN k USING (number, block)) WHERE n > 0 GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_shard AS BIGINT) AS first_shard FROM q LEFT JOIN t USING (r)"""


ORACLE_SQL = _oracle()
