"""Removal of repeated word windows behind a count-min prefilter.

A window is a run of 13 words of one document. A word goes when a window that covers it also starts in
a document with a smaller doc_id; windows are judged on the input.

The documents are first stored as blocks (a few MB of text each, compressed, all columns), so that the
later passes see the same blocks whatever executor runs them. Then
1. each block makes its part of a count-min sketch: per sketch row the cells of its windows, each cell
   at most twice. The sketch is as wide as the corpus asks for, so it is never held whole: a part is a
   sorted list of cells cut by cell range, and ranges are merged by separate tasks, which answer each
   block with those of its cells that count two or more. Counts are never too low, so no repeated
   window is lost;
2. each block sends its windows whose cells are repeated in all rows (the digest of its words and the
   least doc_id that has it, once per block) to be grouped exactly, and is told which of them start in
   a smaller doc_id elsewhere;
3. each block removes the covered words.
Nothing is broadcast and nothing but block counts reaches the driver. A window that a third of all
documents hold is sent once per block, not once per document. The sketch's cells come from a cheap hash of
the words, which may make different windows meet and never parts equal ones; in the second pass a window
is its words, joined by single spaces, under 128 bits of BLAKE2b, for which no two texts that meet are known.

Defined cases: a null text has no words (and stays null in `clean`); a null doc_id counts as larger than
any other, the largest long too; rows that repeat a doc_id never remove each other's words; texts of fewer
than 13 words stay; a text of any length is one row of one block; an empty table gives an empty table; other
columns are carried by `clean`, whatever their names; n_chars, if there is one, follows the text.
"""

from __future__ import annotations

import hashlib
import itertools
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagequarry.llm.common import TextWords, multipliers, stored, tidy, window_hashes

WINDOW = 13
#: Rows of the sketch, and how many cells it has for each window of the corpus.
DEPTH, SPARE = 2, 8
#: Bytes of text in a block, and documents in it at most.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 8192
#: Cells of all blocks that one merging task takes.
SHARD_CELLS = 3_000_000

_COEF = multipliers(WINDOW, 11)


# ---------------------------------------------------------------- packed columns of integers
def _pack(x: np.ndarray, presorted: bool = False) -> bytes:
    """Byte planes of the values (of their differences, if they are sorted), compressed."""
    x = x.astype(np.uint64)
    if presorted and len(x):
        x = np.concatenate((x[:1], np.diff(x)))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(b: bytes, presorted: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if presorted else x


# ---------------------------------------------------------------- blocks
def _blocks(batches):
    """Rows -> blocks: an id, the bytes of text, and the rows as compressed Arrow."""
    task = TaskContext.get().partitionId()
    seq = 0
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def block():
        sink = pa.BufferOutputStream()
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        with pa.ipc.new_stream(sink, held[0].schema, options=options) as w:
            for h in held:
                w.write_batch(h)
        arrays = [
            pa.array([(task << 32) + seq], pa.int64()),
            pa.array([size], pa.int64()),
            pa.array([sink.getvalue().to_pybytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "bytes", "rows"])

    for b in batches:
        lengths = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = int(lengths[at - 1]) if at else 0
            end = int(np.searchsorted(lengths, base + BLOCK_BYTES - size)) + 1
            end = max(at + 1, min(end, b.num_rows, at + BLOCK_ROWS - rows))
            held.append(b.slice(at, end - at))
            rows += end - at
            size += int(lengths[end - 1]) - base
            at = end
            if size >= BLOCK_BYTES or rows >= BLOCK_ROWS:
                yield block()
                seq, held, rows, size = seq + 1, [], 0, 0
    if held:
        yield block()


def blocks_of(docs: DataFrame) -> DataFrame:
    return stored(docs.mapInArrow(tidy(_blocks), "block long, bytes long, rows binary"), "blocks", "uncompressed")


def _table(rows: bytes) -> pa.Table:
    with pa.ipc.open_stream(rows) as r:
        return r.read_all()


class Windows:
    """The windows of a block: a cheap 64-bit hash for each, its doc and first word."""

    def __init__(self, rows: bytes):
        self.table = _table(rows)
        ids = self.table.column("doc_id").cast(pa.int64()).combine_chunks()
        self.named = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.words = TextWords(self.table.column("text"))
        counts = self.words.counts()
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        n = max(0, len(owner) - WINDOW + 1)
        self.at = np.flatnonzero(owner[:n] == owner[len(owner) - n :])  # the first word of each window
        self.doc = owner[self.at]
        self.hash = window_hashes(self.words.hashes(0), WINDOW, _COEF)[self.at]

    def cells(self, row: int, bits: int) -> np.ndarray:
        by = multipliers(DEPTH, 13)[row]
        return (self.hash * by) >> np.uint64(64 - bits)

    def suspects(self, replies: dict[int, list[np.ndarray]], bits: int) -> np.ndarray:
        """Indexes of the windows whose estimate is two or more: the least over the sketch's rows."""
        ok = np.ones(len(self.doc), bool)
        for row in range(DEPTH):
            got = replies.get(row)
            if not got:
                return np.zeros(0, np.int64)
            ok[ok] = _among(self.cells(row, bits)[ok], np.sort(np.concatenate(got)))
        return np.flatnonzero(ok)

    def digests(self, suspects: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for the words of each of these windows, as two columns."""
        spaced, start, stop = self.words.spaced()
        first = self.at[suspects]
        text = memoryview(spaced)
        made = [blake2b(text[a:b], digest_size=16).digest() for a, b in zip(start[first].tolist(), stop[first + WINDOW - 1].tolist())]
        both = np.frombuffer(b"".join(made), ">u8").astype(np.uint64).reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])

    def keyed(self, suspects: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct suspects, sorted by digest: its two columns, least doc_id, whether there is one; and each suspect's index there."""
        h1, h2 = self.digests(suspects)
        d, named = self.ids[self.doc[suspects]], self.named[self.doc[suspects]]
        order = np.lexsort((d, ~named, h2, h1))
        h1, h2 = h1[order], h2[order]
        new = _firsts(h1, h2)
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        return h1[new], h2[new], d[order][new], named[order][new], index


def _firsts(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Where a new value begins in two sorted columns."""
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return new


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each x is among the sorted known ones: a bit per hashed value settles most, a search the rest."""
    bits = max(16, int(len(known)).bit_length() + 3)
    by, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    seen = np.zeros(1 << bits, bool)
    seen[(known * by) >> shift] = True
    ok = seen[(x * by) >> shift]
    some = x[ok]
    ok[ok] = known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some
    return ok


# ---------------------------------------------------------------- pass 1: the sketch
def _sketch(bits: int, shards: int):
    def run(batches):
        for b in batches:
            for block, rows in zip(b.column("block").to_pylist(), b.column("rows")):
                w = Windows(rows.as_py())
                out = []
                for row in range(DEPTH):
                    cells = np.sort(w.cells(row, bits))
                    if not len(cells):
                        continue
                    twice = np.zeros(len(cells), bool)
                    twice[2:] = cells[2:] == cells[:-2]  # a third and later one adds nothing
                    cells = cells[~twice]
                    cuts = np.searchsorted(cells, _bounds(bits, shards))
                    out += [(block, row, s, cells[x:y]) for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if x < y]
                yield _rows(out, "row", "shard")

    return tidy(run)


def _bounds(bits: int, shards: int) -> np.ndarray:
    return np.array([((s << bits) + shards - 1) // shards for s in range(shards)] + [(1 << bits) - 1], np.uint64) + np.array(
        [0] * shards + [1], np.uint64
    )


def _rows(out: list[tuple], *keys: str) -> pa.RecordBatch:
    arrays = [pa.array([o[0] for o in out], pa.int64())]
    arrays += [pa.array([o[1 + i] for o in out], pa.int32()) for i in range(len(keys))]
    arrays.append(pa.array([_pack(o[-1], True) for o in out], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["block", *keys, "cells"])


def _merge(t: pa.Table) -> pa.Table:
    """Blocks' parts of one cell range -> for each block its cells that count two or more."""
    row = t.column("row")[0].as_py()
    blocks = t.column("block").to_pylist()
    parts = [_unpack(c.as_py(), True) for c in t.column("cells")]
    cells = np.sort(np.concatenate(parts), kind="stable")
    repeated = np.unique(cells[1:][cells[1:] == cells[:-1]])
    out = []
    if len(repeated):
        for block, p in zip(blocks, parts):
            p = np.unique(p)
            p = p[repeated[np.minimum(np.searchsorted(repeated, p), len(repeated) - 1)] == p]
            if len(p):
                out.append((block, row, p))
    return pa.Table.from_batches([_rows(out, "row")])


# ---------------------------------------------------------------- pass 2: exact groups
def _ask(bits: int, shards: int):
    def run(batches):
        for b in batches:
            for block, rows, got in zip(b.column("block").to_pylist(), b.column("rows"), b.column("cells").to_pylist()):
                replies = _replies(got)
                if len(replies) < DEPTH:
                    continue
                w = Windows(rows.as_py())
                h1, h2, low, named, _ = w.keyed(w.suspects(replies, bits))
                cuts = np.searchsorted(h1, _bounds(64, shards)[:-1]).tolist() + [len(h1)]
                out = [
                    (block, s, x, _pack(h1[x:y], True), _pack(h2[x:y]), _pack(low[x:y]), np.packbits(named[x:y]).tobytes())
                    for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:]))
                    if x < y
                ]
                yield _batch(out, _ASKED)

    return tidy(run)


def _replies(got) -> dict[int, list[np.ndarray]]:
    replies: dict[int, list[np.ndarray]] = {}
    for g in got or ():
        replies.setdefault(g["row"], []).append(_unpack(g["cells"], True))
    return replies


_ASKED = {"block": pa.int64(), "shard": pa.int32(), "base": pa.int64(), **dict.fromkeys(("h1", "h2", "low", "named"), pa.binary())}
_TOLD = {"block": pa.int64(), "at": pa.binary(), "low": pa.binary()}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def _ddl(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {_SQL[kind]}" for name, kind in columns.items())


def _batch(out: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(columns.values())], names=list(columns))


def _group(t: pa.Table) -> pa.Table:
    """The least doc_id of each window of one digest range; a block hears of those that start earlier elsewhere."""
    h1s, h2s, lows = ([_unpack(x.as_py(), c == "h1") for x in t.column(c)] for c in ("h1", "h2", "low"))
    sizes = [len(x) for x in h1s]
    nameds = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).view(bool) for x, n in zip(t.column("named"), sizes)]
    h1, h2, low, named = np.concatenate(h1s), np.concatenate(h2s), np.concatenate(lows).view(np.int64), np.concatenate(nameds)
    order = np.lexsort((low, ~named, h2, h1))
    new = _firsts(h1[order], h2[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    least, known = low[order][new][group], named[order][new][group]
    earlier = known & (~named | (least < low))
    out, at = [], 0
    for block, base, n in zip(t.column("block").to_pylist(), t.column("base").to_pylist(), sizes):
        m = np.flatnonzero(earlier[at : at + n])
        if len(m):
            out.append((block, _pack(m + base, True), _pack(least[at + m])))
        at += n
    return pa.Table.from_batches([_batch(out, _TOLD)])


# ---------------------------------------------------------------- pass 3: removal
def _gone(w: Windows, replies, answers, bits: int) -> np.ndarray:
    """A mask of the block's words to remove."""
    gone = np.zeros(len(w.words.start), bool)
    suspects = w.suspects(replies, bits)
    if not len(suspects):
        return gone
    _, _, low, named, index = w.keyed(suspects)
    for a in answers or ():
        at = _unpack(a["at"], True).astype(np.int64)
        low[at], named[at] = _unpack(a["low"]).view(np.int64), True
    doc = w.doc[suspects]
    hit = w.at[suspects[named[index] & (~w.named[doc] | (w.ids[doc] > low[index]))]]
    for i in range(WINDOW):
        gone[hit + i] = True
    return gone


def _removed(bits: int, keep_rows: bool, schema: pa.Schema | None):
    def run(batches):
        for b in batches:
            for rows, got, answers in zip(b.column("rows"), b.column("cells").to_pylist(), b.column("answers").to_pylist()):
                w = Windows(rows.as_py())
                gone = _gone(w, _replies(got), answers, bits)
                if keep_rows:
                    yield from _cleaned(w, gone, schema)
                    continue
                removed = _per_doc(w, gone)
                left = _left(w, gone, removed, np.arange(len(removed)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.ids, pa.int64(), mask=~w.named),
                        pa.array(w.words.counts(), pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return tidy(run)


def _per_doc(w: Windows, gone: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(gone)))
    return sums[w.words.first[1:]] - sums[w.words.first[:-1]]


def _left(w: Windows, gone: np.ndarray, removed: np.ndarray, docs: np.ndarray):
    """The words that are left of each of these documents, joined by single spaces."""
    first, at = w.words.first, w.words.offsets
    for d in docs:
        words = w.words.data[at[d] : at[d + 1]].tobytes().split()
        if removed[d]:
            words = itertools.compress(words, ~gone[first[d] : first[d + 1]])
        yield b" ".join(words)


def _cleaned(w: Windows, gone: np.ndarray, schema: pa.Schema):
    """The rows, with the text of those that lose words replaced by the words that are left."""
    removed = _per_doc(w, gone)
    changed = np.flatnonzero(removed)
    t = w.table.combine_chunks()
    if len(changed):
        new = dict(zip(changed.tolist(), (x.decode() for x in _left(w, gone, removed, changed))))
        mask = pa.array(removed > 0)

        def put(name: str, values: list) -> None:
            nonlocal t
            field = t.schema.field(name)
            column = t.column(name).combine_chunks()
            column = pc.replace_with_mask(column, mask, pa.array(values, field.type))
            t = t.set_column(t.schema.get_field_index(name), field, column)

        put("text", [new[d] for d in changed.tolist()])
        if "n_chars" in t.column_names:
            put("n_chars", [len(new[d]) for d in changed.tolist()])
    yield from t.select([f.name for f in schema]).cast(schema).to_batches()


def _plan(docs: DataFrame):
    blocks = blocks_of(docs)
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    windows = max(1, size // 6)
    bits = min(56, int(np.ceil(np.log2(windows * SPARE))) + 1)
    shards = max(1, -(-windows // SHARD_CELLS))
    narrow = blocks.select("block", "rows")
    parts = narrow.mapInArrow(_sketch(bits, shards), "block long, row int, shard int, cells binary")
    merged = parts.groupBy("row", "shard").applyInArrow(_merge, "block long, row int, cells binary")
    found = stored(merged, "repeated", "uncompressed")
    # Both joins shuffle the same blocks for the same kind of join, so that Spark does it once.
    per_block = found.groupBy("block").agg(F.collect_list(F.struct("row", "cells")).alias("cells"))
    asked = narrow.join(per_block, "block", "left").mapInArrow(_ask(bits, shards), _ddl(_ASKED))
    answers = asked.groupBy("shard").applyInArrow(_group, _ddl(_TOLD))
    told = answers.groupBy("block").agg(F.collect_list(F.struct("at", "low")).alias("answers"))
    return narrow.join(per_block.join(told, "block", "left"), "block", "left"), bits


def removals(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    whole, bits = _plan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return whole.mapInArrow(_removed(bits, False, None), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame) -> DataFrame:
    """docs without the repeated words; documents that lose none keep their text as it was."""
    from pyspark.sql.pandas.types import to_arrow_schema

    whole, bits = _plan(docs)
    return whole.mapInArrow(_removed(bits, True, to_arrow_schema(docs.schema)), docs.schema)
