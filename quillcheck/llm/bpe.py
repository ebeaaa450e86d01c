"""Byte-level BPE encoding and decoding.

Text is split by a pattern; each match (piece) is merged on its own. A segment tree over the piece's byte
positions holds, for every live position, the rank of the pair that starts there, with the position in the low
bits, so that the root is the leftmost pair of least rank. A merge rewrites three leaves (the merged part, its
live left neighbour, the part that went) and their paths to the root: a logarithmic number of point updates.
Trees of many pieces of a like size are kept in one array and take their merges in step.

Pieces are looked up in a per-worker memory of bounded size first; it saves time and never changes a result.
Null and empty texts encode as empty lists; texts of any length are taken whole, in blocks. Repeated rows are encoded alike, an
empty table gives an empty result, and other columns are left alone. The rank file's path is a parameter; the file stays where it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, flat, free, table, tidy

#: Pieces that a worker remembers, and their longest size in bytes.
REMEMBERED, REMEMBERED_BYTES = 60_000, 64
#: Tree nodes that are merged in step, and pieces of a width below which each is merged alone.
NODES, FEW = 1 << 17, 24
#: Bytes of text whose pieces are merged together.
TEXT_BYTES = 1 << 19


#: The pattern of runs (contractions; letters, digits or other characters after at most one space; white space)
#: that ``split_runs`` computes without a regular expression. Other patterns go through the regex library.
RUNS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER, _SPACE, _LETTER, _DIGIT = range(4)
_KINDS: list[np.ndarray] = []


# First and last code points of the letters and digits that version 16 of Unicode adds to version 15.1, which Python's
# tables have; tokenizers of these rank files split by version 16.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
DIGITS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


def _kinds() -> np.ndarray:
    """The kind of every code point."""
    if not _KINDS:
        from unicodedata import category

        kinds = np.zeros(0x110000, np.uint8)
        known = {"L": _LETTER, "N": _DIGIT}
        for low in range(0, 0x110000, 0x8000):
            kinds[low : low + 0x8000] = [known.get(category(chr(c))[0], _OTHER) for c in range(low, low + 0x8000)]
        for kind, added in ((_LETTER, LETTERS_16), (_DIGIT, DIGITS_16)):
            for first, last in added:
                kinds[first : last + 1] = kind
        kinds[[c for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]] = _SPACE
        _KINDS.append(kinds)
    return _KINDS[0]


def split_runs(texts: list[str | None]) -> tuple[np.ndarray, pa.Array]:
    """``Bpe.split`` for the pattern RUNS, on arrays of code points: a piece starts where the kind of character
    changes, but for a single space before a run, which joins it, and for contractions."""
    texts = [t or "" for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    whole = "".join(texts)
    chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = len(chars)
    if not n:
        return np.zeros(len(texts), np.int64), pa.array([], pa.large_string())
    kind = _kinds()[chars]
    edge = np.zeros(n + 1, bool)  # where a text starts
    edge[0] = edge[n] = True
    edge[ends] = True
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # white space before other characters leaves its last character to itself, and if that is a space, to the run
    turn = np.flatnonzero(start[1:n] & ~edge[1:n] & (kind[:-1] == _SPACE)) + 1
    start[turn - 1] = True
    start[turn[chars[turn - 1] == 32]] = False
    # contractions start at an apostrophe that starts a piece
    quote = np.flatnonzero((chars[:-1] == 39) & start[: n - 1] & ~edge[1:n])
    if len(quote):
        one = chars[quote + 1]
        more = quote + 2 < n
        two = np.where(more, chars[np.minimum(quote + 2, n - 1)], 0)
        two[edge[np.minimum(quote + 2, n)]] = 0
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        for some, size in ((single, 2), (double & ~single, 3)):
            start[quote[some] + 1] = False
            stop = quote[some] + size
            # within what would be a run of letters, the rest of the run is a piece of its own
            start[stop[stop < n]] = True
    at = np.flatnonzero(start[:n])
    widths = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
    bytes_at = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
    offsets = np.concatenate([bytes_at[at], bytes_at[n:]])
    counts = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
    return counts, pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(whole.encode())])


class Bpe:
    """Merge tables of a rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.tokens = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[t] for t in self.tokens], np.int64)
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("a byte has no rank")
        self.base = int(self.ids.max()) + 1
        keys, made = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        sizes = np.zeros(self.base, np.int64)
        sizes[self.ids] = [len(t) for t in self.tokens]
        self.sizes = sizes
        self.starts = np.zeros(self.base, np.int64)
        self.starts[self.ids] = np.cumsum([0, *(len(t) for t in self.tokens[:-1])])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.whole = ranks
        #: Pairs looked up of late by ``_merge_one``, and pieces met of late and before.
        self.pairs: dict[int, int | None] = {}
        self.memory: tuple[dict[str, tuple[int, ...]], ...] = ({}, {})

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that two neighbours make, or ``base`` where they make none."""
        if not len(self.keys):
            return np.full(len(left), self.base)
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], self.base)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each piece."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.whole.get(piece)
            if rank is not None:
                out[i] = (rank,)
            elif piece:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            if len(rows) < FEW:
                for i in rows:
                    out[i] = self._merge_one(pieces[i])
                continue
            step = max(1, NODES // (2 * width))
            for k in range(0, len(rows), step):
                own = rows[k : k + step]
                for i, ids in zip(own, self._merge_like([pieces[j] for j in own], width)):
                    out[i] = ids
        return out

    def _merge_like(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.zeros((n, width), np.uint8)
        raw[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        place = np.arange(width)
        part = self.byte_ids[raw].reshape(-1)
        after = np.tile(place + 1, n)
        before = np.tile(place - 1, n)
        live = (place < sizes[:, None]).reshape(-1)
        shift = width.bit_length() - 1
        none = self.base << shift
        tree = np.full(n * 2 * width, none)
        left = np.flatnonzero(live & (np.tile(place, n) + 1 < np.repeat(sizes, width)))
        ranks = self.pair_rank(part[left], part[left + 1])
        row, at = left >> shift, left & width - 1
        tree[(row << shift + 1) + width + at] = np.where(ranks < self.base, ranks << shift | at, none)
        grid, level = tree.reshape(n, 2 * width), width
        while level > 1:
            np.minimum(grid[:, level : 2 * level : 2], grid[:, level + 1 : 2 * level : 2], out=grid[:, level // 2 : level])
            level //= 2
        root = np.arange(n) << shift + 1
        root = root[tree[root + 1] < none]
        while len(root):
            top = tree[root + 1]
            at = top & width - 1
            cell = root >> 1  # the row's first byte position
            gone = after[cell + at]
            follow = after[cell + gone]
            size = sizes[root >> shift + 1]
            part[cell + at] = top >> shift
            after[cell + at] = follow
            live[cell + gone] = False
            inner = follow < size
            before[(cell + follow)[inner]] = at[inner]
            here = np.where(inner, self.pair_rank(part[cell + at], part[cell + np.minimum(follow, width - 1)]), self.base)
            ahead = before[cell + at]
            some = ahead >= 0
            r, a = root[some], ahead[some]
            there = self.pair_rank(part[cell[some] + a], part[(cell + at)[some]])
            tree[root + width + gone] = none
            tree[root + width + at] = np.where(here < self.base, here << shift | at, none)
            tree[r + width + a] = np.where(there < self.base, there << shift | a, none)
            base, node = np.concatenate([root, root, r]), np.concatenate([gone, at, a]) + width
            while node[0] > 1:  # the three leaves' paths to the root
                own = base + node
                node = node >> 1
                tree[base + node] = np.minimum(tree[own], tree[own ^ 1])
            root = root[tree[root + 1] < none]
        flat, ends = part[live].tolist(), np.cumsum(live.reshape(n, width).sum(axis=1)).tolist()
        return [tuple(flat[i:j]) for i, j in zip([0, *ends], ends)]

    def _merge_one(self, piece: bytes) -> tuple[int, ...]:
        """The same tree for a single long piece, in plain Python lists."""
        base, n = self.base, len(piece)
        known, keys = self.pairs, self.keys
        if len(known) > REMEMBERED:
            known.clear()

        def pair(left: int, right: int) -> int | None:
            key = left * base + right
            if key not in known:
                at = int(np.searchsorted(keys, key))
                known[key] = int(self.made[at]) if at < len(keys) and keys[at] == key else None
            return known[key]

        width = 1 << (n - 1).bit_length()
        part = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = base * width
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pair(part[i], part[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def update(at: int, key: int) -> None:
            node = at + width
            tree[node] = key
            while node > 1:
                a, b = tree[node], tree[node ^ 1]
                node >>= 1
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            follow = after[at] = after[gone]
            part[at] = rank
            part[gone] = -1
            update(gone, none)
            rank = None
            if follow < n:
                before[follow] = at
                rank = pair(part[at], part[follow])
            update(at, none if rank is None else rank * width + at)
            if (ahead := before[at]) >= 0:
                rank = pair(part[ahead], part[at])
                update(ahead, none if rank is None else rank * width + ahead)
        return tuple(x for x in part if x >= 0)

    def split(self, texts: list[str | None]) -> tuple[np.ndarray, pa.Array]:
        """How many pieces each text has, and all pieces in a row."""
        if self.pattern.pattern == RUNS:
            return split_runs(texts)
        found = [self.pattern.findall(text) if text else [] for text in texts]
        return np.array([len(f) for f in found], np.int64), pa.array(list(chain.from_iterable(found)), pa.large_string())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (with the end).

        The distinct pieces of all these texts are merged together.
        """
        counts, pieces = self.split(texts)
        pieces = pieces.dictionary_encode()
        which, distinct = pieces.indices.to_numpy(), pieces.dictionary.to_pylist()
        new, old = self.memory
        ids = [new.get(p) or old.get(p) for p in distinct]
        fresh = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(fresh, self.merge([distinct[i].encode() for i in fresh])):
            ids[i] = x
            if len(distinct[i]) <= REMEMBERED_BYTES:
                new[distinct[i]] = x
        if len(new) > REMEMBERED // 2:
            self.memory = ({}, new)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        first = np.concatenate([[0], np.cumsum(sizes)])
        own = sizes[which]
        to = np.concatenate([[0], np.cumsum(own)])
        out = flat[np.repeat(first[which] - to[:-1], own) + np.arange(to[-1])]
        return out, to[np.cumsum([0, *counts])]

    def rest(self) -> None:
        """Keep the tables only: workers live on beside those of later stages."""
        self.pairs, self.memory = {}, ({}, {})
        tidy()

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id lists in a row, and where each list's bytes start (with the end)."""
        sizes = self.sizes[ids]
        to = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(self.starts[ids] - to[:-1], sizes) + np.arange(to[-1])
        return self.bytes[take], to[ends]


_LOADED: dict[tuple[str, str], Bpe] = {}


def _tables(path: str, pattern: str) -> Bpe:
    """One copy of the tables in each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe.load(path, pattern)
    return _LOADED[path, pattern]


def _encode(bpe: Bpe, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and where each text's ids start, for blocks of texts of bounded size."""
    for i, j in blocks(flat(texts)[1], TEXT_BYTES):
        yield bpe.encode(texts.slice(i, j - i).to_pylist())


def _decode(bpe: Bpe, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    body, starts = bpe.decode(ids, ends)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(body)])


def _lists(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """Array of token ids of a text column."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _tables(path, pattern)
        for texts in batches:
            for ids, starts in _encode(bpe, texts):
                yield _lists(ids, starts)
        bpe.rest()

    return encode(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of an array of token ids; a null array gives no bytes."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        bpe, parts = _tables(path, pattern), []
        for at in range(0, len(lists), 1024):
            own = lists.slice(at, 1024)
            ends = np.cumsum([0, *(own.value_lengths().fill_null(0).to_pylist())])
            parts.append(_decode(bpe, own.flatten().to_numpy(zero_copy_only=False), ends))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return decode(ids)


CODED = "struct<token_ids:array<int>,decoded:binary>"


def code_column(text: Column, path: str, pattern: str) -> Column:
    """Token ids of a text and the bytes that these ids give back, in one pass over Python."""

    @F.arrow_udf(CODED)
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _tables(path, pattern)
        for texts in batches:
            for ids, starts in _encode(bpe, texts):
                yield pa.StructArray.from_arrays([_lists(ids, starts), _decode(bpe, ids, starts)], ["token_ids", "decoded"])
        bpe.rest()

    return code(text)


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the split pattern that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``coded`` of ``token_ids`` (array of int) and ``decoded`` (the bytes that these ids give back).

    A column of that name is an error, so that none is lost."""
    free(docs, "coded")
    return docs.withColumn("coded", code_column(F.col(text), path, pattern))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded; counts and digests."""
    docs = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), *tokenizer())
    ids, decoded = F.col("coded.token_ids"), F.col("coded.decoded")
    return docs.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )
