"""Byte-level BPE encoding and decoding with a public vocabulary, merges found by segment trees.

The ranks of a piece's adjacent pairs are the leaves of a segment tree whose root is the lowest rank, leftmost of
equal ones; that merge is made, the leaves beside it are updated up to the root, until no pair can merge. Trees of
many distinct pieces of one padded length run in step as rows of an array, so a merge costs each tree a few array
operations per level, and a piece is encoded once per worker as long as the bounded memo holds it.

The vocabulary file is the one of the tokenizers library; its special token, found anywhere in a text, is one id.

Defined results: a null or empty text has no tokens; any string decodes to itself; a very long piece (one run of
letters, say) is one tree whose work grows as n log n, some microseconds a merge; ids that aren't in the vocabulary can't be decoded and raise
KeyError; other columns don't take part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Fixed: how byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers in each of two generations, and characters of these; longer pieces aren't remembered.
MEMO, MEMO_CHARS, LONG = 400_000, 8_000_000, 1_000
#: Fewer trees than this run one by one; and leaves of the trees that run in step.
FEW, STEP = 48, 1 << 17
_NONE = np.int64(1) << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable Latin-1 stays, the rest goes from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], _byte_chars()
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(chars[c] for c in s) for s, i in ids.items() if s not in self.special}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        self.byte_id = np.zeros(256, np.int64)
        for i, s in self.bytes_of.items():
            if len(s) == 1:
                self.byte_id[s[0]] = i
        self.base = max(self.bytes_of) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = np.array([ids[a] for a, _ in merges]), np.array([ids[b] for _, b in merges])
        key = left * self.base + right
        # pairs by a hash, open to the next place; and by the bytes themselves, for pairs that haven't merged yet
        self.bits = max(4, 2 + len(key).bit_length())
        self.key, self.rank = np.full(1 << self.bits, -1), np.full(1 << self.bits, _NONE)
        for k, r in zip(key.tolist(), range(len(key))):
            at = self._place(k)
            while self.key[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.key[at], self.rank[at] = k, r
        self.made = np.array([ids[a + b] for a, b in merges] + [0])
        self.rank_of = dict(zip(key.tolist(), range(len(merges))))
        one = self.byte_id[:, None] * self.base + self.byte_id[None, :]
        self.first = np.array([self.rank_of.get(k, _NONE) for k in one.ravel().tolist()])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.memo: dict[str, tuple[int, ...]] = {s: (i,) for s, i in self.special.items()}
        self.older: dict[str, tuple[int, ...]] = {}
        self.chars = 0

    def _place(self, key):
        return (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it can't merge; -1 stands for no token."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.base + b, -2)
        at = self._place(key)
        found = self.key[at]
        out = np.where(found == key, self.rank[at], _NONE)
        left = np.flatnonzero((found >= 0) & (found != key) & (key >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.key[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.rank[at[left[hit]]]
            left = left[(found >= 0) & ~hit]
        return out

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece; pieces share the padded length of the longest."""
        n, size = len(words), 2
        lengths = np.fromiter(map(len, words), np.int64, n)
        while size < lengths.max():
            size *= 2
        kind = np.int32 if size * (len(self.made) + 1) < 1 << 31 else np.int64
        none = np.iinfo(kind).max
        inside = np.arange(size) < lengths[:, None]
        raw = np.zeros((n, size), np.int64)
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        tok = np.where(inside, self.byte_id[raw], -1).astype(kind)
        rows = np.arange(n)
        # flat arrays, a row of each for a piece; leaves hold rank * size + position, so that the root is the lowest
        # rank, leftmost of equal ones
        tree = np.full((n, 2 * size), none, kind)
        rank = np.where(inside[:, 1:], self.first[raw[:, :-1] * 256 + raw[:, 1:]], _NONE)
        tree[:, size : 2 * size - 1] = np.where(rank < _NONE, rank * size + np.arange(size - 1), none)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        nxt = np.tile(np.arange(1, size + 1, dtype=kind), (n, 1)).ravel()
        prv = np.tile(np.arange(-1, size - 1, dtype=kind), (n, 1)).ravel()
        tree, flat = tree.ravel(), tok.ravel()

        def update(leaf: np.ndarray, value: np.ndarray, base: np.ndarray) -> None:
            k = leaf + size
            tree[base + k] = value
            for _ in range(size.bit_length() - 1):
                k = k >> 1
                tree[base + k] = np.minimum(tree[base + 2 * k], tree[base + 2 * k + 1])

        while True:
            root = tree[rows * (2 * size) + 1]
            live = root < none
            rows, root = rows[live], root[live].astype(np.int64)
            if not len(rows):
                break
            row, base = rows * size, rows * (2 * size)
            pos, new = root % size, self.made[root // size]
            gone = nxt[row + pos].astype(np.int64)
            after = nxt[row + gone].astype(np.int64)
            before = prv[row + pos].astype(np.int64)
            flat[row + pos] = new
            flat[row + gone] = -1
            nxt[row + pos] = after
            more = after < size
            prv[(row + after)[more]] = pos[more]
            right = np.where(more, flat[row + np.minimum(after, size - 1)], -1)
            left = np.where(before >= 0, flat[row + np.maximum(before, 0)], -1)
            r, m = self._ranks(np.concatenate([new, left]), np.concatenate([right, new])).reshape(2, -1)
            update(gone, none, base)
            update(pos, np.where(r < _NONE, r * size + pos, none), base)
            update(np.where(before >= 0, before, gone), np.where(m < _NONE, m * size + before, none), base)
        keep = tok >= 0
        ids, ends = tok[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends)]

    def merge_one(self, word: bytes) -> tuple[int, ...]:
        """Ids of one piece, of any length."""
        n, size, base, ranks, made = len(word), 2, self.base, self.rank_of, self.made.tolist() if len(word) > LONG else self.made
        while size < n:
            size *= 2
        none = 1 << 60
        tok = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(tok[i] * base + tok[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        while (root := tree[1]) < none:
            pos, gone = root % size, nxt[root % size]
            new, after, before = int(made[root // size]), nxt[gone], prv[pos]
            tok[pos], tok[gone], nxt[pos] = new, -1, after
            r = None
            if after < n:
                prv[after] = pos
                r = ranks.get(new * base + tok[after])
            leaves = [(gone, none), (pos, none if r is None else r * size + pos)]
            if before >= 0:
                r = ranks.get(tok[before] * base + new)
                leaves.append((before, none if r is None else r * size + before))
            for k, value in leaves:
                k += size
                while k and tree[k] != value:
                    tree[k] = value
                    a, b = tree[k], tree[k ^ 1]
                    value = a if a < b else b
                    k >>= 1
        return tuple(t for t in tok if t >= 0)

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts the ids of pieces into the memo, in groups of like length so that padding stays small."""
        groups: dict[int, list[str]] = {}
        for p in pieces:
            groups.setdefault(max(len(p.encode("utf-8")) - 1, 1).bit_length(), []).append(p)
        for bits, group in groups.items():
            step = max(1, STEP >> bits)
            for i in range(0, len(group), step):
                some = group[i : i + step]
                words = [p.encode("utf-8") for p in some]
                self.memo.update(zip(some, self.merge(words) if len(some) >= FEW else map(self.merge_one, words)))
                self.chars += sum(map(len, some))

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.pieces.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.pieces.findall(part)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.split(t or "") for t in texts]
        if len(self.memo) > MEMO or self.chars > MEMO_CHARS:
            # pieces in use are carried over from the generation before; the rest goes with the next one
            self.memo, self.older, self.chars = {s: (i,) for s, i in self.special.items()}, self.memo, 0
        memo, older = self.memo, self.older
        found = [list(map(memo.get, c)) for c in cut]
        missing = {p for c, f in zip(cut, found) if None in f for p, ids in zip(c, f) if ids is None}
        if missing:
            carried = missing.intersection(older)
            memo.update((p, older[p]) for p in carried)
            self.chars += sum(map(len, carried))
            self.learn(missing.difference(older))
            found = [list(map(memo.get, c)) if None in f else f for c, f in zip(cut, found)]
            for p in missing:
                if len(p) > LONG:
                    del memo[p]
                    self.chars -= len(p)
        return [list(chain.from_iterable(f)) for f in found]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(id, ids): the token ids of every whole text, and the columns to keep beside them."""
    path, names = vocabulary or default_vocabulary(), [f"keep{i}" for i in range(len(keep))]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names)])
    types = dict(rows.dtypes)
    schema = ", ".join([f"`{id_col}` {types['id']}, ids array<int>", *[f"`{c}` {types[n]}" for c, n in zip(keep, names)]])
    return map_rows(rows, lambda c: [c["id"], load(path).encode_batch(c["text"]), *[c[n] for n in names]], schema, 512)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text): the text of every list of token ids; null counts as no ids."""
    path, rows = vocabulary or default_vocabulary(), df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_rows(rows, lambda c: [c["id"], [load(path).decode(i or ()) for i in c["ids"]]], f"`{id_col}` {dict(rows.dtypes)['id']}, text string", 256)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: every whole text encoded and its ids decoded, in one pass."""
    path, rows = vocabulary or default_vocabulary(), _texts(df, id_col, text_col)

    def run(cols: dict) -> list:
        bpe = load(path)
        n, ids_sha, text_sha = [], [], []
        digits = _Digits(bpe.base)
        for ids in bpe.encode_batch(cols["text"]):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
        return [cols["id"], n, ids_sha, text_sha]

    return map_rows(rows, run, f"`{id_col}` {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string", 512)


@lru_cache(maxsize=2)
def _Digits(base: int):
    return [str(i) for i in range(base)].__getitem__


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
