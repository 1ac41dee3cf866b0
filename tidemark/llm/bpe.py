"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A text is cut into pieces by the tokenizer's own pattern. The bytes of a piece are
mapped to Latin-1, so an Aho-Corasick automaton over characters finds the vocabulary
entries at every byte. The encoder takes the longest entry, accepts it if it may follow
the entry before it (two neighbours are compatible if merging their joined bytes gives
the two back; the answers are memoised), else tries the next shorter one, and steps
back when none is left. Each position is given up at most once, so the time is linear.

Most of a text's words are short and many are new to a worker. Those of a batch are merged
together before: pair by pair, lowest rank first, one round for all words at a time.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import lean

# The code points with Unicode's White_Space property.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Entries of the generation that a worker fills for chunks of text (it keeps this one and the one before), and of neighbouring tokens.
CACHE_ENTRIES, PAIR_ENTRIES = 60_000, 120_000
#: Above every rank.
NEVER = 1 << 60
#: Bytes of a word, and texts whose words, that are merged together.
SHORT, TOGETHER = 24, 64
#: Bytes of text that a worker encodes before it hands a batch on.
BATCH_BYTES = 2_000_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Codec:
    """Encoder and decoder for one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")).findall
        self.cut = re.compile(f"(?= [^{WHITE_SPACE}])").split
        self.plain = re.compile(f" (?:[{WHITE_SPACE}]|$)").search
        self.automaton = ahocorasick.Automaton()
        self.reached = {t: r for t, r in ranks.items() if self.merged(t) == [t]}
        for token, rank in self.reached.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.size = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of, default=0) + 1)]
        self.fits: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        one = lambda piece: array("i", self.encode_piece(piece.encode("utf-8"))).tobytes()
        self.piece = _Memo(one, CACHE_ENTRIES // 4)
        self.first = _Memo(self._chunk, CACHE_ENTRIES // 8)
        self.spaced = _Memo(lambda word: one(" " + word) if word.isalpha() else self._chunk(" " + word), CACHE_ENTRIES)
        # every pair of entries that joins to an entry, and its rank; keys are in order
        pairs = [(a * len(self.size) + b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        self.pairs = np.array(sorted(pairs) or [(-1, 0)], np.int64).T.copy()
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        # the vocabulary by rank, for decoding whole arrays: what no rank has is null
        self.entries = pa.array([self.bytes_of.get(i) for i in range(len(self.size))], pa.large_binary())

    def forget(self) -> None:
        """Drop what was kept of texts; the vocabulary stays."""
        for memo in (self.piece, self.first, self.spaced):
            memo.clear()
            memo.before = {}
        for kept in (self.fits, self.shorter, *self.edges):
            kept.clear()

    def merged(self, data: bytes, parts_left: int = 1) -> list[bytes]:
        """Plain merging, lowest rank first, down to so many parts; for the few bytes of one token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > parts_left:
            rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: bytes, last: bool) -> list[tuple[bytes, int]]:
        """What stands at the token's last (or first) edge while it is merged: each part, and the rank of the merge that ends it."""
        if (known := self.edges[last].get(token)) is None:
            inner = self.merged(token, 2) if len(token) > 1 else []
            below = [(part, min(until, self.ranks[token])) for part, until in self._edge(inner[-last], last)] if inner else []
            known = self.edges[last][token] = [*below, (token, NEVER)]
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before those that build the two tokens.

        Where ranks tie, the merge further left comes first.
        """
        if (known := self.fits.get((left, right))) is not None:
            return known
        if len(self.fits) > PAIR_ENTRIES:
            self.fits.clear()
        before, after, ranks = self._edge(self.bytes_of[left], True), self._edge(self.bytes_of[right], False), self.ranks
        answer = True
        for a, a_ends in before:
            for b, b_ends in after:
                rank = ranks.get(a + b, NEVER)
                if rank < a_ends and rank <= b_ends:
                    answer = False
        self.fits[left, right] = answer
        return answer

    def _next_shorter(self, token: int) -> int:
        """The longest entry that begins the token's bytes and is shorter, or -1."""
        if (known := self.shorter.get(token)) is None:
            data = self.bytes_of[token]
            known = self.shorter[token] = next((self.reached[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.reached), -1)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, size, fits = len(piece), self.size, self.fits
        # mostly the longest entries one after another fit; neighbours that all fit are the answer
        latin, taken, end = piece.decode("latin-1"), [], 0
        for last, (before, rank) in self.automaton.iter_long(latin):
            if last - before != end or taken and not (fits[taken[-1], rank] if (taken[-1], rank) in fits else self._may_follow(taken[-1], rank)):
                break
            taken.append(rank)
            end = last + 1
        if end == n:
            return taken
        # those taken so far are the longest that fit, so the search goes on from them
        known = end - size[taken[-1]] if taken else 0
        longest, given_up = self._longest(latin, known), set()
        if not taken:
            taken, end = [longest[0]], size[longest[0]]
        while end < n or end in given_up:
            # taken ends at `end`: find what may come next, or else replace the last token
            last, token = taken[-1], longest[end] if end < n else -1
            while token >= 0 and (end + size[token] in given_up or not (fits[last, token] if (last, token) in fits else self._may_follow(last, token))):
                token = self._next_shorter(token)
            while token < 0:  # no encoding passes through this place
                given_up.add(end)
                token = taken.pop()
                end -= size[token]
                if end < known:
                    known, longest = 0, self._longest(latin, 0)
                token = self._next_shorter(token)
                while token >= 0 and (end + size[token] in given_up or taken and not self._may_follow(taken[-1], token)):
                    token = self._next_shorter(token)
            taken.append(token)
            end += size[token]
        return taken

    def _joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two neighbours joined; NEVER without one (-1 is no entry)."""
        keys, ranks = self.pairs
        key = left.astype(np.int64) * len(self.size) + right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (left >= 0) & (right >= 0), ranks[at], NEVER)

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as bytes, by plain merging of all at once; for short pieces that are no entries themselves."""
        length = np.array([len(p) for p in pieces])
        width = int(length.max(initial=1))
        ids = self.single[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)]
        there = np.arange(width) < length[:, None]
        if (ids[there] < 0).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        ids[~there] = -1
        joint, place, out = self._joint(ids[:, :-1], ids[:, 1:]), np.arange(len(pieces)), [b""] * len(pieces)
        while len(place):
            # the leftmost of the lowest; a row without any is done
            rows = np.arange(len(place))
            i = joint.argmin(1) if joint.shape[1] else np.zeros(len(place), np.int64)
            lowest = joint[rows, i] if joint.shape[1] else np.full(len(place), NEVER)
            done = lowest == NEVER
            flat, ends = ids[done], np.cumsum((ids[done] >= 0).sum(1)) * 4
            data, start = flat[flat >= 0].tobytes(), 0
            for at, end in zip(place[done].tolist(), ends.tolist(), strict=True):
                out[at] = data[start:end]
                start = end
            place, ids, joint, i, lowest = place[~done], ids[~done], joint[~done], i[~done], lowest[~done]
            if not len(place):
                break
            rows, cols = np.arange(len(place)), np.arange(ids.shape[1] - 1)
            ids[rows, i] = lowest
            ids = np.take_along_axis(ids, cols + (cols > i[:, None]), 1)
            joint = np.take_along_axis(joint, cols[:-1] + (cols[:-1] >= i[:, None]), 1)
            for at in (i - 1, i):  # the neighbours of what was joined
                own = np.flatnonzero((at >= 0) & (at < joint.shape[1]))
                joint[own, at[own]] = self._joint(ids[own, at[own]], ids[own, at[own] + 1])
        return out

    def learn(self, texts: list[str | None]) -> None:
        """Encode the short words of the texts that aren't known yet together, each as it is after a space."""
        words: set[str] = set()
        for t in texts:
            if t:
                words.update(t.split(" "))
        # a mark after a word is a piece of its own
        words = {w if w.isalpha() else w[:-1] for w in words}
        known, before, new = self.spaced, self.spaced.before, []
        for w in words:
            if w in known or not w.isalpha():
                continue
            if (ids := before.get(w)) is not None:
                known.keep(w, ids)
            elif len(p := (" " + w).encode("utf-8")) <= SHORT and p not in self.ranks:
                new.append((w, p))
        if new:
            for (word, _), ids in zip(new, self.merged_together([p for _, p in new]), strict=True):
                known.keep(word, ids)

    def _longest(self, latin: str, start: int) -> list[int]:
        """The longest entry that begins at each place from ``start`` on."""
        out = [-1] * len(latin)
        for last, (before, rank) in self.automaton.iter(latin, start):
            out[last - before] = rank  # of matches from one place, the longest comes last
        if -1 in out[start:]:
            raise ValueError("the vocabulary lacks a byte of the text")
        return out

    def _chunk(self, chunk: str) -> bytes:
        # a word is kept once, whatever marks follow it
        return b"".join([self.spaced[p[1:]] if p[0] == " " and p[1:].isalpha() else self.piece[p] for p in self.pieces(chunk)])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text. No piece spans the space before a word, so what lies between such spaces is encoded once and kept, as the bytes of its ids."""
        if not text:
            return np.empty(0, np.int32)
        if self.plain(text):
            head, *rest = self.cut(text)
            known = map(self.first.__getitem__, rest)
        else:
            head, *rest = text.split(" ")
            known = map(self.spaced.__getitem__, rest)
        return np.frombuffer(self.first[head] + b"".join(known), np.int32)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each row of ids (null ids: none), gathered for all rows at once."""
        if ids.null_count:
            ids = pc.if_else(ids.is_null(), pa.scalar([], ids.type), ids)
        got = self.entries.take(ids.flatten())
        if got.null_count:
            raise ValueError("an id is null or not in the vocabulary")
        _, offsets, data = got.buffers()
        ends = np.frombuffer(offsets, np.int64)[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
        rows = ids.offsets.to_numpy().astype(np.int64)
        # entries lie one after another, so a row's bytes lie between those of its first and its last id
        bounds = ends[rows - rows[0]]
        raw = data if data is not None else pa.py_buffer(b"")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(bounds.tobytes()), raw]).cast(pa.binary())


class _Memo(dict):
    """Answers of a function in two generations: when one is full, the one before is forgotten. Very long keys aren't kept."""

    def __init__(self, answer, most: int):
        super().__init__()
        self.answer, self.most, self.before = answer, most, {}

    def __missing__(self, key):
        out = self.before.get(key)
        if out is None:
            out = self.answer(key)
        if len(key) <= 64:
            self.keep(key, out)
        return out

    def keep(self, key, out) -> None:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = out


@lru_cache(maxsize=2)
def codec(raw: bytes, pattern: str) -> Codec:
    return Codec(read_ranks(raw), pattern)


def _slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about BATCH_BYTES at most, so that long texts can't pile up."""
    column = batch.column(name)
    size, start = 0, 0
    for i in range(batch.num_rows):
        value = column[i]
        size += 100 + (value.as_buffer().size if value.is_valid and pa.types.is_string(column.type) else 4 * len(value) if value.is_valid else 0)
        if size >= BATCH_BYTES:
            yield batch.slice(start, i + 1 - start)
            size, start = 0, i + 1
    if start < batch.num_rows:
        yield batch.slice(start)


def _as_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.int32)])))


def _appended(df: DataFrame, column: str, out: dict[str, T.DataType], make, forget) -> DataFrame:
    """``df`` and more columns, made from batches of ``column`` in Python; ``forget`` is called after a task's last one."""
    if clash := [c for c in out if c in df.columns]:
        raise ValueError(f"the table already has a column {clash[0]}")
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, kind) for c, kind in out.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, column):
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(column))], [*part.schema.names, *out])
        forget()

    return df.mapInArrow(lean(run), schema)


def _vocabulary(df: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the ids of each whole text as ``out_col`` (array of int), and, if ``decoded_col``
    is given, the bytes that these ids stand for (binary), decoded in the same pass.

    A null or empty text has no ids. Rows are independent: copies, ties and other
    columns (null or not) don't matter; an empty table stays empty. The vocabulary
    (under 1 MB, fixed) is read on the driver and broadcast. A column named like a new one
    that is already there is an error.
    """
    raw = _vocabulary(df, ranks_path)
    out = {out_col: T.ArrayType(T.IntegerType(), True)} | ({decoded_col: T.BinaryType()} if decoded_col else {})

    def make(texts: pa.Array) -> list[pa.Array]:
        own = codec(raw.value, pattern)
        rows, made = texts.to_pylist(), []
        for i in range(0, len(rows), TOGETHER):
            own.learn(rows[i : i + TOGETHER])
            made += map(own.encode, rows[i : i + TOGETHER])
        ids = _as_lists(made)
        return [ids, own.decode(ids)] if decoded_col else [ids]

    return _appended(df, text_col, out, make, lambda: codec(raw.value, pattern).forget())


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids_col`` stands for as ``out_col`` (binary).

    A null row of ids gives no bytes; a null id and one that is not in the vocabulary are errors.
    Rows are independent; an empty table stays empty; a column named ``out_col`` is an error.
    """
    raw = _vocabulary(df, ranks_path)
    return _appended(df, ids_col, {out_col: T.BinaryType()}, lambda ids: [codec(raw.value, pattern).decode(ids)], lambda: None)


def digests(df: DataFrame, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """Counts and digests in place of the ids and bytes."""
    return df.select(
        "doc_id",
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col), 256).alias("decoded_sha256"),
    )
