"""N-gram Jaccard join: documents whose sets of word shingles have a similarity of 0.75 or more.

Candidates come from PartEnum signatures. Sets are dealt into bands of near equal size. A band's
hash divides the domain of shingles into partitions of three parts each, and of each partition
all subsets of two parts are enumerated: what a set holds in such a subset is one signature. Two
linked sets differ in at most k shingles, k following from their sizes, so at most k / 2
partitions can differ in two of their parts; in all others the sets share a whole signature. In
the first band, of small sets, each shingle is a partition of one part, whose only subset is itself.

How many signatures a set surely shares with a linked one, less those that are *hot* (had by many
sets), is how many cold ones they share at least: all pairs in cold buckets are looked at, and
those that share fewer are dropped before any set is read.

Sets with too few cold signatures (large groups of near copies, texts made of passages that
are everywhere) go another exact way: in every hot bucket they are compared with one hub after
another as long as the bucket holds more than one component, and what is still apart then
is compared with each other in blocks. Links are verified on the sets themselves.

Equal sets are one node from the start, so copies cost nothing; nodes are 64-bit keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import shingles
from tidemark.llm.common import lean, packed, unpacked, written
from tidemark.llm.components import components

#: Similarity for a link, as a fraction: 100 * common >= 75 * all.
NUMERATOR, DENOMINATOR = 75, 100
#: Upper bounds of the size bands; in the first, each shingle is a partition of its own. Above it, bands go on by the factor.
FIRST_BAND, BAND_FACTOR = 128, 2
#: Partitions of a band per shingle of its largest set: linked sets differ in k <= 1/3 of these, so k / 2 partitions are fewer.
PARTITIONS = 0.22
#: Parts of a partition, and the subsets of them that are signatures.
PARTS, SUBSETS = 3, ((0, 1), (1, 2), (0, 2))
#: Sets that share a cold signature at most.
COLD = 16
#: Tasks over which the members of one hot signature are dealt in joins.
SLOTS = COLD
#: Sets of a block that are compared with those of another at once, where buckets stay hot.
BLOCK = 2048
#: Signatures that a worker packs at once, and that one target partition should hold.
PACKED_AT_ONCE, PART_SIGNATURES = 500_000, 2_000_000
#: Hubs that are tried in buckets that stay open before their members are compared in blocks.
TURNS = 1
#: Documents whose ids are broadcast to pick their texts; more of them are joined by a shuffle.
BROADCAST_DOCS = 1_000_000

U = np.uint64
#: A signature's highest bits, which name its band; of a signature, its highest 48 bits go on.
BAND_BITS, KEPT_BITS = U(5), U(48)


def band_of(size: np.ndarray) -> np.ndarray:
    """The band of a set: 0 up to FIRST_BAND shingles, then one more for each BAND_FACTOR."""
    return np.where(size <= FIRST_BAND, 0, np.ceil(np.log(np.maximum(size, FIRST_BAND) / FIRST_BAND) / np.log(BAND_FACTOR) - 1e-12)).astype(np.int64)


def top_of(band: np.ndarray) -> np.ndarray:
    return FIRST_BAND * BAND_FACTOR ** np.asarray(band, np.int64)


def families(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the one or two bands that a set takes part in: the sets' numbers, their bands, how many signatures each shares at least with a linked set, and the signatures with their sets.

    A set also takes part in the band below if a set there can be linked with it.
    """
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    for lower in (0, 1):
        band = band_of(size) - lower
        there = (size > 0) & (band >= 0)
        if lower:
            there &= size * NUMERATOR <= top_of(np.maximum(band, 0)) * DENOMINATOR
        shared = np.zeros(len(size), np.int64)
        found = []
        use = np.flatnonzero((there & (band == 0))[owner])
        if len(use):
            own, h = owner[use], hashes[use]
            found.append((own, shingles.mix(shingles.mix(h) + shingles.mix(h))))
            shared += np.where(band == 0, np.bincount(own, minlength=len(size)) - size // 3, 0)
        use = np.flatnonzero((there & (band > 0))[owner])
        if len(use):
            own, h = owner[use], hashes[use]
            found.extend(_subsets(own, h, band, size, shared))
        own = np.concatenate([o for o, _ in found]) if found else np.empty(0, np.int64)
        signature = np.concatenate([x for _, x in found]) if found else np.empty(0, U)
        signature = signature >> BAND_BITS | band[own].astype(U) << (U(64) - BAND_BITS)
        numbers = np.flatnonzero(there)
        yield numbers, band[numbers], shared[numbers], signature, own


def _subsets(own: np.ndarray, h: np.ndarray, band: np.ndarray, size: np.ndarray, shared: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(set, signature) of all subsets of parts that aren't empty, for shingles ``h`` of the sets ``own``; sets ``shared`` of these sets."""
    top = top_of(np.maximum(band, 0))
    partitions = np.ceil(top * PARTITIONS).astype(np.int64)
    part = (shingles.mix(h ^ U(0x2545F4914F6CDD1D)) % (partitions[own] * PARTS).astype(U)).astype(np.int64)
    order = np.argsort(own * (int(partitions.max()) * PARTS + 1) + part, kind="stable")
    own, part, h = own[order], part[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (part[1:] != part[:-1])]))
    content = np.add.reduceat(shingles.mix(h), first)
    own, part = own[first], part[first]
    partition = part // PARTS
    at = np.concatenate([[True], (own[1:] != own[:-1]) | (partition[1:] != partition[:-1])])
    held, row = np.zeros((int(at.sum()), PARTS), U), np.cumsum(at) - 1
    held[row, part % PARTS] = content
    there = held != 0
    of, number = own[at], partition[at].astype(U)
    # a partition with two parts or more that aren't empty has no empty subset
    whole = np.bincount(of[there.sum(1) >= 2], minlength=len(size))
    differ = np.where(size <= top, size // 3, (size + top) // 7)
    least = whole - differ // 2
    mine = np.zeros(len(size), bool)
    mine[own] = True
    shared[mine] = np.maximum(least, 1)[mine]
    out = []
    for k, (i, j) in enumerate(SUBSETS):
        some = there[:, i] | there[:, j]
        out.append((of[some], shingles.mix(shingles.mix(held[some, i] + U(k)) + held[some, j] + shingles.mix(number[some] * U(4) + U(k)))))
    # the few sets with too many empty subsets to be sure of a shared one: among themselves they share single parts
    thin = (least < 1)[own]
    out.append((own[thin], shingles.mix(content[thin] + shingles.mix(part[thin].astype(U) + U(1 << 40)))))
    return out


def describe(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, node (key of the shingle set; null if it is empty), size, and bands: (band, how many signatures a linked set shares at least)."""
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    kept = source.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            for a, b in shingles.slices(texts):
                hashes, bounds = shingles.sets(texts.slice(a, b - a))
                size, node = np.diff(bounds), shingles.set_keys(hashes, bounds)
                bands: list[list[dict]] = [[] for _ in range(b - a)]
                for numbers, band, shared, _, _ in families(hashes, bounds):
                    for i, k, n in zip(numbers.tolist(), band.tolist(), shared.tolist(), strict=True):
                        bands[i].append({"band": k, "shared": n})
                columns = [batch.column(c).slice(a, b - a) for c in keep]
                kind = pa.list_(pa.struct([("band", pa.int32()), ("shared", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(node, mask=size == 0), pa.array(size), pa.array(bands, kind)], [*keep, "node", "size", "bands"])

    made = T.StructType.fromDDL("node long, size long, bands array<struct<band:int,shared:int>>")
    return source.mapInArrow(lean(run), T.StructType([*kept.fields, *made.fields]))


def _signatures(docs: DataFrame, parts: int, text_col: str) -> DataFrame:
    """(part, payload): the signatures of each input partition, packed per target partition.

    Of a signature that more than COLD sets of one input partition have, COLD + 1 go to its
    target; the other sets only report that they have it, to a place that their node decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, signatures, known = [], [], 0
        index: dict[int, int] = {}
        for batch in batches:
            texts = batch.column(0)
            for a, b in shingles.slices(texts):
                hashes, bounds = shingles.sets(texts.slice(a, b - a))
                keys = shingles.set_keys(hashes, bounds)
                before = len(index)
                number = np.array([index.setdefault(k, len(index)) for k in keys.tolist()])
                fresh = np.zeros(len(keys), bool)
                fresh[np.unique(number, return_index=True)[1]] = True
                fresh &= number >= before  # an equal set has been seen
                for _, _, _, signature, owner in families(hashes, bounds):
                    use = fresh[owner]
                    signatures.append(signature[use])
                    nodes.append(number[owner[use]].astype(np.uint32))
                    known += int(use.sum())
            if known > PACKED_AT_ONCE:  # bounds a worker's memory; the rest of the partition is packed apart
                yield from _pack(index, nodes, signatures, parts)
                nodes, signatures, known, index = [], [], 0, {}
        if known:
            yield from _pack(index, nodes, signatures, parts)

    return docs.select(F.col(text_col)).mapInArrow(lean(run), "part int, payload binary")


def _pack(index: dict[int, int], nodes: list, signatures: list, parts: int) -> Iterator[pa.RecordBatch]:
    keys = np.fromiter(index, np.int64, len(index))
    node, sig = np.concatenate(nodes), np.concatenate(signatures)
    del nodes[:], signatures[:]
    order = np.argsort(sig, kind="stable")
    node, sig = node[order], sig[order]
    over = np.zeros(len(sig), bool)
    over[COLD + 1 :] = sig[COLD + 1 :] == sig[: -COLD - 1]
    to = sig % U(parts)
    to[over] = keys[node[over]].astype(U) % U(parts)
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to, np.arange(parts + 1, dtype=U), sorter=order)
    del to
    out = []
    for p in range(parts):
        rows = order[bounds[p] : bounds[p + 1]]
        if len(rows):
            local, place = np.unique(node[rows], return_inverse=True)
            head = np.array([len(local), len(rows), int(over[rows].sum())], np.int64)
            rows_over = np.argsort(~over[rows], kind="stable")
            wide = np.uint16 if len(local) < 65_536 else np.uint32
            # six bytes of a signature besides its target tell signatures apart as candidates; links are verified later
            short = sig[rows][rows_over].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
            out.append((p, head.tobytes() + keys[local].tobytes() + place[rows_over].astype(wide).tobytes() + np.ascontiguousarray(short).tobytes()))
        if len(out) == 64 or out and p == parts - 1:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "payload"])
            out = []


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Nodes, signatures (48 bits) and how many of the first only report a hot signature."""
    local, rows, over = np.frombuffer(payload, np.int64, 3)
    at = 24 + 8 * local
    keys = np.frombuffer(payload, np.int64, local, 24)
    wide = np.uint16 if local < 65_536 else np.uint32
    place = np.frombuffer(payload, wide, rows, at)
    short = np.frombuffer(payload, np.uint8, 6 * rows, at + rows * place.itemsize).reshape(-1, 6)
    sig = np.zeros((rows, 8), np.uint8)
    sig[:, :6] = short
    return keys[place], sig.view("<u8").ravel(), int(over)


PAIR, HOT = 0, 1


def _buckets(packed: DataFrame) -> DataFrame:
    """(kind, a, b, band, n): pairs in cold buckets with how many they share here, and (node, signature) of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for batch in batches:
            for p, payload in zip(batch.column("part").to_pylist(), batch.column("payload"), strict=True):
                by_part.setdefault(p, []).append(payload.as_buffer().to_pybytes())
        for p in list(by_part):
            blobs = [_unpacked(payload) for payload in by_part.pop(p)]
            hot_node = np.concatenate([n[:o] for n, _, o in blobs])
            hot_sig = np.concatenate([s[:o] for _, s, o in blobs])
            node = np.concatenate([n[o:] for n, _, o in blobs])
            sig = np.concatenate([s[o:] for _, s, o in blobs])
            del blobs
            order = np.lexsort((node, sig))
            node, sig = node[order], sig[order]
            if len(sig):
                keep = np.ones(len(sig), bool)  # equal sets from different input partitions
                keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
                node, sig = node[keep], sig[keep]
                new = np.ones(len(sig), bool)
                new[1:] = sig[1:] != sig[:-1]
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(sig)))
                in_hot = np.repeat(count > COLD, count)
                hot_node, hot_sig = np.concatenate([hot_node, node[in_hot]]), np.concatenate([hot_sig, sig[in_hot]])
                left, right, bands = [], [], []
                for m in range(2, COLD + 1):
                    starts = first[count == m]
                    if len(starts):
                        members = node[starts[:, None] + np.arange(m)]
                        i, j = np.triu_indices(m, 1)
                        left.append(members[:, i].ravel())
                        right.append(members[:, j].ravel())
                        bands.append(np.repeat(_band(sig[starts]), len(i)))
                if left:
                    pairs = np.stack([np.concatenate(left), np.concatenate(right), np.concatenate(bands)], 1)
                    pairs = pairs[np.lexsort(pairs.T)]
                    new = np.ones(len(pairs), bool)
                    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
                    at = np.flatnonzero(new)
                    yield _rows(PAIR, *pairs[at].T, np.diff(np.append(at, len(pairs))))
            if len(hot_node):
                yield _rows(HOT, hot_node, hot_sig.view(np.int64), _band(hot_sig), np.ones(len(hot_node), np.int64))

    return packed.mapInArrow(lean(run), "kind int, a long, b long, band int, n long")


def _band(signature: np.ndarray) -> np.ndarray:
    return (signature >> (KEPT_BITS - BAND_BITS)).astype(np.int64)


def _rows(kind: int, a: np.ndarray, b: np.ndarray, band: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(band.astype(np.int32)), pa.array(n.astype(np.int64))], ["kind", "a", "b", "band", "n"])


def _sets_of(docs: DataFrame, nodes: DataFrame, described: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles) of the given nodes, each read from the text of its smallest document; shingles: sorted 64-bit hashes."""
    chosen = described.join(nodes, "node").groupBy("node").agg(F.min("row_key").alias("row_key"))
    chosen = written(chosen, "chosen-documents")
    if chosen.count() <= BROADCAST_DOCS:
        chosen = F.broadcast(chosen)
    texts = docs.join(chosen, "row_key").select("node", F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a repeated row is a copy of the chosen one
        for batch in batches:
            fresh = [n not in seen and not seen.add(n) for n in batch.column("node").to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            text, node = batch.column("_text"), batch.column("node")
            for a, b in shingles.slices(text):
                hashes, bounds = shingles.sets(text.slice(a, b - a))
                ends = pa.array((bounds * 8).astype(np.int32))
                yield pa.RecordBatch.from_arrays([node.slice(a, b - a), pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, ends.buffers()[1], pa.py_buffer(hashes.tobytes())])], ["node", "shingles"])

    return texts.mapInArrow(lean(run), "node long, shingles binary")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    there = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            fine = [linked(np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return there.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component yet."""
    out = pairs.join(roots.withColumnsRenamed({"node": "a", "root": "_ra"}), "a", "left").join(roots.withColumnsRenamed({"node": "b", "root": "_rb"}), "b", "left")
    return out.filter(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).drop("_ra", "_rb")


def _best(pairs: DataFrame) -> DataFrame:
    """For each node the partner with which it shares most."""
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    return best.select("a", "b")


def join(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of its equal sets) and component_id (smallest doc_id reachable by links) of every row.

    Gives components, not links: pairs of texts that are in one component already are not
    verified, so links within a component are neither listed nor counted.
    A null or empty text and one without words have no shingles and are linked with nothing,
    not even each other; with fewer words than a shingle has, the whole is one. Copies are
    one class. Rows with a null doc_id are linked by their text; a component of such rows
    alone has a null id. Repeated rows get equal results; a repeated doc_id with different
    texts counts for each. An empty table gives an empty result; other columns are ignored.
    """
    described, roots = _joined(docs, text_col)
    return _labelled(described, roots)


def _joined(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, node, size, bands) of every row, and (node, root) of all nodes with links."""
    spark = docs.sparkSession
    source = docs.select("doc_id", F.col(text_col).alias("text")).withColumn("row_key", F.struct("doc_id", F.xxhash64("text").alias("text_key")))
    described = written(describe(source, "text", ("doc_id", "row_key")), "described")
    held = described.filter("node is not null")
    total = held.agg(F.sum("size")).first()[0] or 0  # about one signature per shingle
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_SIGNATURES))
    found = written(_buckets(_signatures(source, parts, "text").repartition(parts, "part")), "signature-buckets")

    need = held.select("node", F.explode("bands").alias("b")).groupBy("node", F.col("b.band").alias("band")).agg(F.first("b.shared").alias("shared"))
    hot = found.filter(F.col("kind") == HOT).select(F.col("a").alias("node"), "band", F.col("b").alias("signature")).distinct()
    hot = written(hot, "hot-signatures")
    heat = hot.groupBy("node", "band").agg(F.count("*").alias("hot"))
    # of the signatures that a linked set shares at least, so many are cold
    margin = F.col("shared") - F.coalesce("hot", F.lit(0))
    nodes = written(need.join(heat, ["node", "band"], "left").select("node", "band", margin.alias("margin"), F.coalesce("hot", F.lit(0)).alias("hot")), "nodes")

    pairs = found.filter(F.col("kind") == PAIR).groupBy("a", "b", "band").agg(F.sum("n").alias("n"))
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), "band", F.col("margin").alias(f"_{side}")), [side, "band"])
    pairs = written(pairs.filter("n >= _a and n >= _b").groupBy("a", "b").agg(F.max("n").alias("n")), "candidate-pairs")

    # of an unsafe set, the rarest hot signatures that make up for the cold ones it lacks: two linked sets share one of these
    rarity = hot.groupBy("signature").agg(F.count("*").alias("of"))
    unsafe = _by_signature(hot.join(nodes.filter("margin <= 0"), ["node", "band"]), rarity)
    place = F.row_number().over(Window.partitionBy("node", "band").orderBy("of", "signature"))
    members = written(unsafe.withColumn("place", place).filter("place <= 1 - margin").select("node", "signature", "hot"), "hot-members")

    everyone = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct()
    sets = written(_sets_of(source, everyone, held, "text"), "sets")

    links = written(_verified(_best(pairs), sets), "links-best")
    roots = components(links)
    links = links.union(written(_verified(_apart(pairs.select("a", "b"), roots), sets), "links-rest"))
    roots = components(links)
    for turn in range(TURNS):
        members = _open(members, roots)
        if members.isEmpty():
            break
        more = written(_verified(_apart(_spokes(members, turn), roots), sets), "links-spokes")
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links)
    members = _open(members, roots)
    if not members.isEmpty():
        more = written(_verified(_apart(_near(_blocks(members, roots), sets), roots), sets), "links-blocks")
        roots = components(links.union(more))
    return described, roots


def _by_signature(members: DataFrame, signatures: DataFrame, how: str = "inner") -> DataFrame:
    """``members`` joined with a row per hot signature, the members of one dealt over SLOTS tasks.

    A hot signature has more than COLD members, so the other side repeated for each slot is no larger than ``members``.
    """
    each = signatures.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    return members.withColumn("_slot", F.pmod(F.xxhash64("node"), F.lit(SLOTS)).cast("int")).join(each, ["signature", "_slot"], how).drop("_slot")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of hot buckets that hold more than one component."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = rooted.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("signature")
    return written(_by_signature(members, open_, "left_semi"), "hot-open")


def _spokes(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of each bucket's hub with its other members.

    The first hub is the set that shares most of its signatures, which of near copies is the one
    they all come from; the next are chosen by a hash, alike in buckets with like members.
    """
    rank = F.struct(F.col("hot") if turn == 0 else F.xxhash64("node", F.lit(turn)), "node")
    hubs = members.groupBy("signature").agg(F.max(rank)["node"].alias("hub"))
    met = _by_signature(members, hubs).filter("hub <> node")
    return met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def _blocks(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(signature, node, root, block) of the hot buckets that hold more than one component, where each distinct list of members is left once."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = rooted.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("same")).filter("low <> high")
    open_ = open_.groupBy("n", "same").agg(F.min("signature").alias("signature"), F.first("n").alias("of"))
    return written(_by_signature(rooted, open_.select("signature", "of")).withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("of") / BLOCK))), "hot-blocks")


#: Bits of the sketch that bounds how much two sets differ.
SKETCH = 2048


def _near(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in one hot bucket that may be linked.

    A set's sketch has one bit for each residue of its hashes: whether an odd number of them
    falls there. Two sketches differ in at most as many bits as the sets have different
    members, so pairs that differ too much are dropped exactly. Blocks of a bucket meet two by
    two, each pair of blocks in a task of its own of BLOCK rows a side.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in batch.column("shingles"):
                h = np.frombuffer(s.as_buffer(), U)
                rows.append((np.packbits(np.bincount((h % U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes(), len(h)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["node", "sketch", "size"])

    sketched = written(sets.join(blocks.select("node").distinct(), "node", "left_semi").select("node", "shingles").mapInArrow(lean(sketch), "node long, sketch binary, size long"), "sketches")
    rows = blocks.join(sketched, "node")
    count = F.ceil(F.col("of") / BLOCK).cast("int")
    # block i meets j >= i: each row goes to as many places as its bucket has blocks
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))))
    other = other.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return
        node, root, block, size = (t.column(c).to_numpy() for c in ("node", "root", "block", "size"))
        bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for x in rows:
            apart = np.bitwise_count(bits[x] ^ bits[columns]).sum(1)
            # |x| + |y| - 2 * common <= (1 - J) / (1 + J) * (|x| + |y|)
            near = columns[((root[columns] != root[x]) & (apart * (DENOMINATOR + NUMERATOR) <= (DENOMINATOR - NUMERATOR) * (size[x] + size[columns])))]
            near = near[(i != j) | (node[near] > node[x])]
            if len(near):
                a = np.minimum(node[near], node[x])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.maximum(node[near], node[x]))], ["a", "b"])

    met = other.groupBy("signature", "i", "j").applyInArrow(lambda t: _table(meet(t.to_batches())), "a long, b long")
    return met.distinct()


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _labelled(described: DataFrame, roots: DataFrame) -> DataFrame:
    """Every row with the smallest doc_id of its class and component."""
    classes = described.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    classes = written(classes.join(least, "root").select("node", "class_id", "component_id"), "classes")
    own = described.select("doc_id", F.col("size").alias("n_shingles"), "node")
    return own.join(classes, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def dedupe(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` left when of each component only one stays, with all their columns, whatever their names.

    It is the row with the smallest doc_id, a null one coming last; of several texts under that
    id, that with the smallest hash. Each row goes by its own text: another text under the id of a
    row that goes is not touched. Of rows equal in doc_id and text one stays. Rows whose text is
    null, empty or without words have no shingles and all stay. An empty table stays empty.
    """
    described, roots = _joined(docs, text_col)
    own = described.filter("node is not null").select("node", F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col("row_key.text_key").alias("text_key")).alias("row"))
    rows = own.groupBy("node", "row").agg(F.count("*").alias("times")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = written(rows.select("root", "row", "times"), "rows-by-component")
    first = rows.groupBy("root").agg(F.min("row").alias("first"))
    key = [F.col("row.doc_id").alias("_doc"), F.col("row.text_key").alias("_key")]
    judged = written(rows.join(first, "root").select(*key, (F.col("row") == F.col("first")).alias("stays"), "times"), "rows-judged")
    own = docs.select(packed(docs).alias("row"), "doc_id", F.xxhash64(text_col).alias("text_key"))
    met = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    gone, repeated = (judged.filter(f).select("_doc", "_key") for f in ("not stays or times > 1", "stays and times > 1"))
    left = own.join(F.broadcast(gone) if gone.count() <= BROADCAST_DOCS else gone, met, "left_anti").select("row")
    if not repeated.isEmpty():
        left = left.unionByName(own.join(repeated, met).groupBy("doc_id", "text_key").agg(F.first("row").alias("row")).select("row"))
    return left.select(*unpacked("row", docs.columns))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(g, '|' ORDER BY g)) AS same FROM s GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g GROUP BY 1, 2
), link AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), comp AS (
  SELECT a, b FROM link UNION SELECT comp.a, link.b FROM comp JOIN link ON comp.b = link.a
), root AS (
  SELECT a, min(b) AS component_id FROM comp GROUP BY a
), class AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY same) AS class_id FROM n
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root ON root.a = w.doc_id LEFT JOIN class USING (doc_id)
"""
