"""Packing of documents into sequences of tokens by cutting-stock column generation.

Documents are tokenised and cut at multiples of the sequence length; what remains of each is an item.
Items fall into length classes of GRAIN tokens. Over the histogram of classes a linear program asks for
the fewest sequences; its columns, patterns of classes that fit a sequence, are priced by a knapsack
dynamic program from the duals until none improves, from the patterns of a filling largest first. The solution is rounded down and the rest filled
largest first. Then the documents of each class, ranked without gaps, are assigned to the pattern
slots in order of rank.

Only the histogram (a count for each class) reaches the driver; the assignment is arithmetic on ranks
and the list of patterns, whose length depends on the number of classes and not on the corpus. Token
ids are kept where they are made: a piece carries their checksum, or the ids themselves if asked for.

A sequence is padded to its full length, unless its fill is a power of two.

Defined cases: a null or empty text is the one end token; a text of any length is cut in as many pieces as
it takes; repeated rows and null doc_ids are packed row by row; pieces of a class are ranked by doc_id and
start, and ties fall in any order; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from pagequarry.llm.common import SALT, gapless, gather, packed_ids, salted, segments, starts_of, tidy

LENGTH = 4096
END = 2
#: Tokens in a length class.
GRAIN = 16


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- tokens
#: Bytes of text that are tokenised together, and distinct words in one call of the library.
SEGMENT, AT_ONCE = 16 << 20, 512
#: Letters whose runs any such vocabulary takes as one part.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_TOKENIZERS: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The library's tokenizer, and for each id whether it ends a part (the suffix of word ends)."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are Spark's
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        closes = np.zeros(t.get_vocab_size(), bool)
        closes[[i for token, i in t.get_vocab().items() if token.endswith("</w>")]] = True
        _TOKENIZERS[path] = t, closes
    return _TOKENIZERS[path]


def _alone(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, each encoded by itself: all ids, and how many each word has."""
    encode = _tokenizer(path)[0].encode_batch_fast
    found, lengths = [np.zeros(0, "<u4")], []
    for i in range(0, len(words), AT_ONCE):
        ids = [e.ids for e in encode(words[i : i + AT_ONCE], add_special_tokens=False)]
        lengths += map(len, ids)
        found.append(np.fromiter(itertools.chain.from_iterable(ids), "<u4", sum(lengths[i:])))
    return np.concatenate(found), np.array(lengths, np.int64)


def _together(words: list[str], parts: int, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The same for words that the tokenizer splits in `parts` each, many in one call: a token that ends a part tells them apart."""
    t, closes = _tokenizer(path)
    found, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
    for i in range(0, len(words), AT_ONCE):
        some = words[i : i + AT_ONCE]
        ids = np.array(t.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(closes[ids])[parts - 1 :: parts] + 1
        if len(ends) != len(some) or ends[-1] != len(ids) or closes[ids].sum() != parts * len(some):
            ids, each = _alone(some, path)  # another vocabulary's rules
        else:
            each = np.diff(ends, prepend=0)
        found.append(ids)
        lengths.append(each)
    return np.concatenate(found), np.concatenate(lengths)


def word_ids(words: pa.Array, path: str) -> pa.LargeBinaryArray:
    """The ids of each word as 32-bit little-endian bytes.

    This vocabulary drops white space, and neither its normaliser nor its split looks across it, so the
    words of a text may be encoded apart, and others beside them.
    """
    masks = [pc.match_substring_regex(words, f"^[{LATIN}]+{end}$").to_numpy(zero_copy_only=False) for end in ("", "[.,;:!?)]")]
    masks.append(~(masks[0] | masks[1]))
    rows = [np.flatnonzero(m) for m in masks]
    ids, lengths = [], []
    for parts, at in enumerate(rows, 1):
        some = words.take(pa.array(at)).to_pylist()
        got = _together(some, parts, path) if parts < 3 else _alone(some, path)
        ids.append(got[0])
        lengths.append(got[1])
    packed = packed_ids(np.concatenate(ids), starts_of(np.concatenate(lengths)))
    back = np.empty(len(words), np.int64)
    back[np.concatenate(rows)] = np.arange(len(words))
    return packed.take(pa.array(back))


def token_ids(texts: pa.Array, path: str) -> tuple[memoryview, np.ndarray]:
    """The ids of all texts as bytes, and where each text's begin. A distinct word is encoded once."""
    words = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = words.flatten().dictionary_encode()
    cuts = starts_of(words.value_lengths().to_numpy(zero_copy_only=False))
    return gather(word_ids(coded.dictionary, path), coded.indices.to_numpy(), cuts)


def token_bytes(text: str | None, path: str, end: int = END) -> bytes:
    raw, _ = token_ids(pa.array([text], pa.string()), path)
    return bytes(raw) + struct.pack("<I", end)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, length: int, end: int, with_ids: bool):
    last = struct.pack("<I", end)

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = token_ids(b.column(1), path)
        counts = np.diff(at) // 4 + 1
        each = -(-counts // length)
        owner = np.repeat(np.arange(len(counts)), each)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * length
        sizes = np.minimum(length, counts[owner] - start)
        begin = at[owner] + 4 * start
        stop = np.minimum(begin + 4 * sizes, at[owner + 1])
        ends = (start + sizes == counts[owner]).tolist()
        parts = [raw[x:y] for x, y in zip(begin.tolist(), stop.tolist())]
        crc = [zlib.crc32(last, zlib.crc32(p)) if e else zlib.crc32(p) for p, e in zip(parts, ends)]
        arrays = [b.column(0).take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in (start, sizes, crc, counts[owner]))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            arrays.append(pa.array([bytes(p) + last if e else bytes(p) for p, e in zip(parts, ends)], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        yield from map(cut, segments(batches, 1, SEGMENT))

    return tidy(run)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """The documents' tokens, cut at multiples of `length`; with_ids adds them as 32-bit little-endian bytes."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = _PIECES + (", ids binary" if with_ids else "")
    return narrow.mapInArrow(_pieces(path or tokenizer_path(), length, end, with_ids), schema)


# ---------------------------------------------------------------- the plan
def _price(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack over the capacity."""
    best = np.zeros(room + 1)
    take = np.full(room + 1, -1)
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        fits = np.searchsorted(sizes, w, side="right")
        if fits:
            gain = value[:fits] + best[w - sizes[:fits]]
            i = int(gain.argmax())
            if gain[i] > best[w] + 1e-12:
                best[w], take[w] = gain[i], i
    pattern = np.zeros(len(sizes), np.int64)
    w = room
    while w > 0:
        if take[w] < 0:
            w -= 1
        else:
            pattern[take[w]] += 1
            w -= int(sizes[take[w]])
    return float(best[room]), pattern


def first_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[np.ndarray]:
    """A pattern for each class, by filling sequences largest first: each uses up the class it stands for, so the basis is triangular."""
    left, alive, patterns = demand.astype(float).copy(), np.ones(len(sizes), bool), []
    while alive.any():
        pattern, free = np.zeros(len(sizes), np.int64), room
        for i in np.flatnonzero(alive)[::-1]:
            pattern[i] = min(free // sizes[i], max(1, int(left[i])))
            free -= int(pattern[i] * sizes[i])
        has = pattern > 0
        times = float((left[has] / pattern[has]).min())
        left -= pattern * times
        for k, i in enumerate(np.flatnonzero(has & (left <= 1e-9))):
            if k:  # several are used up at once: the others stand alone
                pattern = np.zeros(len(sizes), np.int64)
                pattern[i] = room // sizes[i]
            patterns.append(pattern)
            alive[i], left[i] = False, 0.0
    return patterns


def relaxed(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The linear program's best basis: patterns and how often each is used, by column generation to the optimum.

    The demand is a little perturbed while columns are exchanged, so that each exchange is a step and none comes back.
    """
    patterns = first_basis(sizes, demand, room)
    inverse = np.linalg.inv(np.array(patterns, float).T)
    x = np.maximum(inverse @ (demand * (1 + 1e-7 * np.sqrt(np.arange(1, len(sizes) + 1)))), 0)
    while True:
        gain, column = _price(sizes, inverse.sum(0), room)
        if gain <= 1 + 1e-9:
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
        step = x[out] / d[out]
        x = np.maximum(x - d * step, 0)
        x[out] = step
        patterns[out] = column
    return patterns, np.maximum(inverse @ demand, 0)


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: items}, sequences that use it) that hold exactly the histogram's items."""
    sizes = np.array(sorted(c for c, n in histogram.items() if n), np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(c)] for c in sizes], np.int64)
    patterns, x = relaxed(sizes, left.astype(float), room)
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        left = left - pattern * times
        out.append(({int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}, times))

    for p, t in sorted(zip(patterns, x), key=lambda q: -q[1]):
        has = p > 0
        times = min(int(t + 1e-6), int((left[has] // p[has]).min()))
        if times > 0:
            use(p, times)
    while left.any():  # the rounded-off rest, largest first
        p, free = np.zeros(len(sizes), np.int64), room
        for i in range(len(sizes) - 1, -1, -1):
            p[i] = min(left[i], free // sizes[i])
            free -= int(p[i] * sizes[i])
        has = p > 0
        use(p, max(1, int((left[has] // p[has]).min())))
    return out


# ---------------------------------------------------------------- assignment
def _slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """class -> sorted first ranks, and for each the items a sequence, the first sequence, the first slot."""
    by: dict[int, list[tuple]] = {}
    seen: dict[int, int] = {}
    base = 0
    for pattern, times in patterns:
        slot = 0
        for c in sorted(pattern, reverse=True):
            by.setdefault(c, []).append((seen.get(c, 0), pattern[c], base, slot))
            seen[c] = seen.get(c, 0) + pattern[c] * times
            slot += pattern[c]
        base += times
    return {c: tuple(np.array(x, np.int64) for x in zip(*rows)) for c, rows in by.items()}


def _assign(slots: dict[int, tuple[np.ndarray, ...]]):
    def run(batches):
        for b in batches:
            cls, rank = b.column("__class").to_numpy(), b.column("__rank_in").to_numpy()
            sequence, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                m = cls == c
                first, each, base, at = slots[int(c)]
                i = np.searchsorted(first, rank[m], side="right") - 1
                r = rank[m] - first[i]
                sequence[m] = base[i] + r // each[i]
                slot[m] = at[i] + r % each[i]
            kept = b.drop_columns(["__class", "__rank_in"])
            arrays = [*kept.columns, pa.array(sequence), pa.array(slot)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept.schema.names, "sequence_id", "__slot"])

    return run


def pack(
    docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False, grain: int = GRAIN
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    room = length // grain
    cut = pieces(docs, path, length, end, with_ids)
    table = salted(cut.withColumn("__class", F.ceil(F.col("length") / grain).cast("long")), "pieces")
    histogram = {r["__class"]: r["count"] for r in table.groupBy("__class").count().collect()}
    slots = _slots(plan(histogram, room))
    narrow = table.drop("ids").withColumn("__piece", F.col(SALT))  # ids meet their piece when all is decided
    ranked = gapless(narrow, ["__class"], ["doc_id", "start", "ids_crc32"], "__rank_in")
    schema = ", ".join(f"{c} {t}" for c, t in ranked.drop("__class", "__rank_in").dtypes) + ", sequence_id long, __slot long"
    placed = ranked.mapInArrow(_assign(slots), schema)
    before = W.partitionBy("sequence_id").orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not with_ids:
        return placed.select(*own)
    return placed.join(table.select(F.col(SALT).alias("__piece"), "ids"), "__piece").select(*own, "ids")
