"""Byte-level BPE encoding and decoding over an index of pair occurrences.

A task takes its partition in segments of SEGMENT bytes of text. The distinct pre-tokens of a segment are
laid out as one array of symbols. An index maps each mergeable pair to all its positions; pairs that have
positions are active, and are applied in ascending rank. A merge rewrites all its positions at once and
moves the pairs on both sides to the lists of their ranks; a position whose pair an earlier merge took is
dropped when its list is read. In this vocabulary every token has one merge, so a merge never wakes a
lower rank; the heap of active ranks would take one if it did. Nothing is kept from segment to segment.

The split into pre-tokens is the vocabulary's pattern. Where a text has single spaces only, it is cut
at the spaces first, since no pre-token then depends on what lies beyond one; other texts go through
the pattern as a whole. Either way gives the same ids.

Defined cases: a null text counts as empty and has no tokens; a special token's string in a text is
that token; a text of any length is one row and is read whole; repeated rows and null doc_ids each give
a row; ranks never tie; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from pagequarry.llm.common import gather, packed_ids, segments, starts_of, tidy

#: White space as the vocabulary's pattern means it.
WS = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WS + r"\p{L}\p{N}]+|[" + WS + r"]+(?![^" + WS + r"])|[" + WS + "]+"
)
_SPLIT = regex.compile(PATTERN)
#: A text with none of these may be cut at its spaces.
_UNEVEN = re.compile("  | \n|\n |[\t\x0b\x0c\r\x85\xa0  -     　]")
#: A chunk of these letters is one pre-token.
_PLAIN = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Bytes of text that share an index.
SEGMENT = 16 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself if printable, else 256 and up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable}
    others = [b for b in range(256) if b not in printable]
    return chars | {chr(256 + i): b for i, b in enumerate(others)}


class Partners:
    """For each token the tokens that it merges with on one side, and the ranks of these merges."""

    def __init__(self, own: np.ndarray, other: np.ndarray, size: int):
        order = np.lexsort((other, own))
        self.other, self.rank = other[order], order.astype(np.int32)
        self.at = np.searchsorted(own[order], np.arange(size + 1)).tolist()

    def of(self, token: int, neighbours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these neighbours merge with the token, and at what rank."""
        low, high = self.at[token], self.at[token + 1]
        if low == high:
            return _NONE, _NONE
        known = self.other[low:high]
        i = np.searchsorted(known, neighbours)
        i[i == high - low] = 0
        hit = np.flatnonzero(known[i] == neighbours)
        return hit, self.rank[low:high][i[hit]]


_NONE = np.zeros(0, np.int32)


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        byte = _byte_of()
        ids = said["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in said["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        size = max([*ids.values(), *self.special.values()]) + 1
        spelt = {i: bytes(byte[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes = pa.array([spelt.get(i, b"") for i in range(size)], pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in range(size)], pa.large_binary())
        self.symbol = np.zeros(256, np.int32)
        for c, b in byte.items():
            self.symbol[b] = ids[c]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in said["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.after = Partners(self.left, self.right, size)
        self.before = Partners(self.right, self.left, size)
        self.first = np.full((256, 256), -1, np.int32)  # ranks of pairs of bytes
        of = {int(i): b for b, i in enumerate(self.symbol)}
        for rank, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            if a in of and b in of:
                self.first[of[a], of[b]] = rank


class PairIndex:
    """rank -> arrays of the positions of that pair, and the heap of ranks that have any."""

    def __init__(self):
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
            if rank not in self.places:
                self.places[rank] = []
                heapq.heappush(self.active, rank)
            self.places[rank].append(positions[a:b])

    def take(self) -> tuple[int, np.ndarray]:
        """The least active rank and its positions, sorted, each once."""
        rank = heapq.heappop(self.active)
        lists = self.places.pop(rank)
        if len(lists) == 1:  # every list is sorted and names a position once
            return rank, lists[0]
        at = np.sort(np.concatenate(lists))
        return rank, at[np.concatenate(([True], at[1:] != at[:-1]))]


def _apart(at: np.ndarray, partner: np.ndarray) -> np.ndarray:
    """Of pairs of one token with itself in a row, the first, third and so on: aaa has one pair aa to merge."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != partner[:-1]
    i = np.arange(len(at))
    return (i - np.maximum.accumulate(np.where(new, i, 0))) % 2 == 0


def merged(data: np.ndarray, cuts: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pre-tokens data[cuts[i]:cuts[i + 1]] one after another, and where each one's begin."""
    lengths = np.diff(cuts)
    size = len(data) + len(lengths) + 1
    place = np.arange(len(data)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)
    symbol = np.full(size, -1, np.int32)  # -1 before, between and after: nothing merges over the end of a pre-token
    symbol[place] = v.symbol[data]
    after, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
    index = PairIndex()
    if len(data):
        rank = v.first[data[:-1], data[1:]]
        has = np.flatnonzero((rank >= 0) & (place[1:] == place[:-1] + 1))
        index.add(place[has].astype(np.int32), rank[has])
    while index.active:
        rank, at = index.take()
        left, right, new = int(v.left[rank]), int(v.right[rank]), int(v.made[rank])
        at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
        partner = after[at]
        if left == right:
            one = _apart(at, partner)
            at, partner = at[one], partner[one]
        beyond = after[partner]
        symbol[at], symbol[partner] = new, -2
        after[at], before[beyond] = beyond, at
        hit, ranks = v.after.of(new, symbol[beyond])
        index.add(at[hit], ranks)
        previous = before[at]
        hit, ranks = v.before.of(new, symbol[previous])
        index.add(previous[hit], ranks)
    left_over = symbol >= 0
    ends = np.cumsum(lengths) + np.arange(1, len(lengths) + 1)
    return symbol[left_over], np.concatenate(([0], starts_of(left_over)[ends]))


def encode_many(tokens: list[bytes], v: Vocabulary) -> list[list[int]]:
    """The ids of each of many pre-tokens, merged together through one index."""
    ids, cuts = merged(np.frombuffer(b"".join(tokens), np.uint8), starts_of([len(t) for t in tokens]), v)
    return [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]


def _buffer(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after another, and where each begins."""
    b = strings.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = b.buffers()
    at = np.frombuffer(offsets, np.int64)[b.offset : b.offset + len(b) + 1] if len(b) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


class Encoder:
    """Texts -> ids and back."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)

    def _coded(self, chunks: pa.Array) -> pa.LargeBinaryArray:
        """The ids of each distinct chunk, packed."""
        plain = pc.match_substring_regex(chunks, _PLAIN).to_numpy(zero_copy_only=False)
        whole, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        split = [_SPLIT.findall(c) if c not in self.v.special else [c] for c in chunks.take(pa.array(odd)).to_pylist()]
        pre = pa.concat_arrays([chunks.take(pa.array(whole)), pa.array([p for s in split for p in s], chunks.type)]).dictionary_encode()
        ids, cuts = merged(*_buffer(pre.dictionary), self.v)
        coded = packed_ids(ids, cuts)
        for token, i in self.v.special.items():
            at = pc.index(pre.dictionary, pa.scalar(token, chunks.type)).as_py()
            if at >= 0:
                coded = pa.concat_arrays([coded.slice(0, at), pa.array([np.int32(i).tobytes()], pa.large_binary()), coded.slice(at + 1)])
        each = np.ones(len(chunks), np.int64)
        each[len(whole) :] = [len(s) for s in split]
        raw, at = gather(coded, pre.indices.to_numpy(), starts_of(each))
        back = np.empty(len(chunks), np.int64)
        back[np.concatenate((whole, odd))] = np.arange(len(chunks))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(at), pa.py_buffer(raw)]).take(pa.array(back))

    def _pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text that is not cut at its spaces, special tokens among them."""
        parts = self.v.cut.split(text) if self.v.cut else [text]
        return [x for p in parts for x in ([p] if p in self.v.special else _SPLIT.findall(p))]

    def _even(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        index, cuts = coded.indices.to_numpy().astype(np.int64), starts_of(words.value_lengths().to_numpy(zero_copy_only=False))
        known = coded.dictionary
        first = index[cuts[:-1]]  # a text's first word has no space in front
        bare, index[cuts[:-1]] = np.unique(first, return_inverse=True)
        spaced = pc.binary_join_element_wise(pa.scalar("", known.type), known, pa.scalar(" ", known.type))
        index[cuts[:-1]] += len(known)
        return gather(self._coded(pa.concat_arrays([spaced, known.take(pa.array(bare))])), index, cuts)

    def _uneven(self, texts: list[str]) -> tuple[memoryview, np.ndarray]:
        split = [self._pieces(t) for t in texts]
        coded = pa.array([p for s in split for p in s], pa.string()).dictionary_encode()
        return gather(self._coded(coded.dictionary), coded.indices.to_numpy(), starts_of([len(s) for s in split]))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _UNEVEN.pattern)
        for token in self.v.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False)
        groups = []
        for which, encode in ((np.flatnonzero(~odd), self._even), (np.flatnonzero(odd), lambda t: self._uneven(t.to_pylist()))):
            if len(which):
                raw, at = encode(texts.take(pa.array(which)) if len(which) < len(texts) else texts)
                groups.append((which, np.frombuffer(raw, np.int32)[: at[-1] // 4], at // 4))
        if len(groups) < 2:
            return groups[0][1:] if groups else (_NONE, np.zeros(1, np.int64))
        coded = pa.concat_arrays([packed_ids(ids, at) for _, ids, at in groups])
        back = np.empty(len(texts), np.int64)
        back[np.concatenate([g[0] for g in groups])] = np.arange(len(texts))
        raw, at = gather(coded, back, np.arange(len(texts) + 1))
        return np.frombuffer(raw, np.int32)[: at[-1] // 4], at // 4

    def encode(self, text: str) -> list[bytes]:
        """The text's ids, as decimal pieces with a comma after each id."""
        return [b"%d," % i for i in self.ids(pa.array([text], pa.string()))[0].tolist()]

    def decode(self, csvs: list[bytes]) -> bytes:
        ids = np.array([int(i) for i in b"".join(csvs).split(b",")[:-1]], np.int32)
        return _valid(gather(self.v.bytes, ids, np.array([0, len(ids)]))[0])


def _valid(raw) -> bytes:
    return bytes(raw).decode("utf-8", "replace").encode()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _digests(path: str):
    def run(batches):
        e = encoder(path)
        for b in segments(batches, 1, SEGMENT):
            ids, cuts = e.ids(b.column(1))
            said, at = gather(e.v.decimal, ids, cuts)
            ends = np.maximum(at[1:] - 1, at[:-1])  # without the last comma
            hashes = [hashlib.sha256(said[x:y]).hexdigest() for x, y in zip(at.tolist(), ends.tolist())]
            plain, at = gather(e.v.bytes, ids, cuts)
            back = [hashlib.sha256(_valid(plain[x:y])).hexdigest() for x, y in zip(at.tolist(), at[1:].tolist())]
            arrays = [b.column(0), pa.array(np.diff(cuts)), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tidy(run)


def _encoded(path: str):
    def run(batches):
        e = encoder(path)
        for b in segments(batches, 1, SEGMENT):
            ids, cuts = e.ids(b.column(1))
            plain, at = gather(e.v.bytes, ids, cuts)
            back = [_valid(plain[x:y]).decode() for x, y in zip(at.tolist(), at[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    return tidy(run)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded of every document."""
    return _narrow(docs).mapInArrow(_encoded(path or vocabulary_path()), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _narrow(docs).mapInArrow(_digests(path or vocabulary_path()), schema)
