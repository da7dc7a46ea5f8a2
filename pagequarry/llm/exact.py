"""Exact deduplication by Grace hash partitioning.

Each scan task removes the copies inside its own split first, so that a group that holds a third of
all rows crosses the shuffle once per split at most. What remains is shuffled by content hash and
deduplicated again. Both passes are the same Grace hash table: records go to spill files by some bits
of their hash, a file that does not fit is split again by the next bits, and one that fits is read
into an open-addressing table that compares complete contents.

A record carries the text as it was; two are equal when their lower-cased bytes are. What a table may
hold counts texts and the other columns' values alike.

Defined cases: a null text counts as empty (and stays null in the row that is kept); only A-Z are
lower-cased; a null doc_id is less than any other; where doc_ids tie, one of the rows stays; rows that
repeat a doc_id and a text count one by one, and one of them stays; a text longer than a table's memory
is held alone; an empty table gives an empty table; other columns are ignored by `groups` and carried by
`deduplicate`, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagequarry.llm.common import segments, tidy

#: Bytes that the records of one table may take; a task has two tables at a time at most.
MEMORY = 32 << 20
#: Spill files of one split; a level uses this many bits of the hash.
BITS = 4
#: What a record costs besides its content, and a value besides its bytes.
OVERHEAD, VALUE = 300, 60
#: Bytes of text that become Python objects at a time.
SLICE = 2 << 20


class OpenTable:
    """content -> record, linear probing; equal means equal lower-cased bytes, never equal hashes alone."""

    def __init__(self, size: int = 64):
        self.slots = [-1] * size
        self.mask = size - 1
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.records: list[list] = []

    def find(self, h: int, content: bytes) -> int:
        i = h & self.mask
        while (at := self.slots[i]) >= 0:
            if self.hashes[at] == h and self.contents[at].lower() == content.lower():
                return at
            i = (i + 1) & self.mask
        if 3 * len(self.records) >= 2 * len(self.slots):
            self._grow()
            return self.find(h, content)
        self.slots[i] = len(self.records)
        self.hashes.append(h)
        self.contents.append(content)
        self.records.append([])
        return self.slots[i]

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        self.mask = len(self.slots) - 1
        for at, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = at


def _weight(record: tuple) -> int:
    row = record[4]
    values = sum(VALUE + (len(v) if isinstance(v, (str, bytes, list, dict)) else 0) for v in row) if row else 0
    return len(record[1] or b"") + OVERHEAD + values


def _rank(doc_id) -> tuple:
    return (doc_id is not None, doc_id or 0)


class Grace:
    """Deduplicate a stream of (digest, text, doc_id, size, row): yields one record per content.

    The record with the largest doc_id stays (the first of those that tie) and gets the sum of sizes. A
    text of None counts as empty; row holds the values of other columns, or is None.
    """

    def __init__(self, memory: int = MEMORY, folder: str | None = None):
        self.memory, self.folder = memory, folder

    def run(self, records: Iterator[tuple]) -> Iterator[tuple]:
        with tempfile.TemporaryDirectory(dir=self.folder) as folder:
            yield from self._level(records, 0, folder)

    def _level(self, records: Iterator[tuple], level: int, folder: str) -> Iterator[tuple]:
        held: list[tuple] = []
        used = 0
        first = None
        single = True
        for r in records:
            held.append(r)
            used += _weight(r)
            first = first or r[0]
            single = single and r[0] == first
            if used > self.memory and not single:
                break
            if used > self.memory:  # one digest so far: its copies need no room
                held = list(self._table(iter(held)))
                used = sum(map(_weight, held))
        else:
            yield from self._table(iter(held))
            return
        if level * BITS >= 240:  # the digest's bits are used up: equal digests, a table of few contents
            yield from self._table(_chain(held, records))
            return
        yield from self._split(_chain(held, records), level, folder)

    def _split(self, records: Iterator[tuple], level: int, folder: str) -> Iterator[tuple]:
        names = [os.path.join(folder, f"{level}-{i}-{os.urandom(4).hex()}") for i in range(1 << BITS)]
        files = [open(n, "wb", buffering=1 << 16) for n in names]
        shift, mask = 256 - BITS * (level + 1), (1 << BITS) - 1
        try:
            for r in records:
                pickle.dump(r, files[(int.from_bytes(r[0], "big") >> shift) & mask], protocol=5)
        finally:
            for f in files:
                f.close()
        for name in names:
            if os.path.getsize(name):
                yield from self._level(_read(name), level + 1, folder)
            os.remove(name)

    def _table(self, records: Iterator[tuple]) -> Iterator[tuple]:
        table = OpenTable()
        for digest, text, doc_id, size, row in records:
            at = table.find(int.from_bytes(digest[-8:], "big"), text or b"")
            kept = table.records[at]
            if not kept:
                kept += [digest, text, doc_id, size, row]
                continue
            kept[3] += size
            if _rank(doc_id) > _rank(kept[2]):
                kept[1:3], kept[4] = (text, doc_id), row
                table.contents[at] = text or b""
        yield from map(tuple, table.records)


def _chain(held: list, rest: Iterator[tuple]) -> Iterator[tuple]:
    held.reverse()
    while held:
        yield held.pop()
    yield from rest


def _read(name: str) -> Iterator[tuple]:
    with open(name, "rb", buffering=1 << 16) as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _grace(memory: int, given: bool, schema: pa.Schema):
    """A mapInArrow function. given: the input has digests already (second pass)."""
    carry = "__rest" in schema.names

    def rows(batches):
        for b in segments(batches, schema.get_field_index("__text"), SLICE):
            ids, texts = b.column("__id").to_pylist(), b.column("__text").to_pylist()
            rest = zip(*(c.to_pylist() for c in b.column("__rest").flatten())) if carry else itertools.repeat(None)
            if given:
                yield from zip(b.column("__digest").to_pylist(), texts, ids, b.column("__size").to_pylist(), rest)
            else:
                for text, doc_id, row in zip(texts, ids, rest):
                    yield hashlib.sha256((text or b"").lower()).digest(), text, doc_id, 1, row  # lower() of bytes: A-Z only

    def run(batches):
        out: list[tuple] = []
        used = 0
        for r in Grace(memory).run(rows(batches)):
            out.append(r)
            used += len(r[1] or b"")
            if used > SLICE or len(out) >= 5000:
                yield _batch(out, schema)
                out, used = [], 0
        if out:
            yield _batch(out, schema)

    return tidy(run)


def _batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    digests, texts, ids, sizes, rows = zip(*out)
    named = {"__id": ids, "__text": texts, "__digest": digests, "__size": sizes}

    def column(f: pa.Field) -> pa.Array:
        if f.name in named:
            return pa.array(named[f.name], f.type)
        parts = [pa.array(values, k.type) for values, k in zip(zip(*rows), f.type)]
        return pa.StructArray.from_arrays(parts, fields=list(f.type))

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def _distinct(docs: DataFrame, carry: list[str], memory: int) -> DataFrame:
    """One row per content: __id, __text, __digest, __size and a struct for the columns `carry`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    picked = [F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("binary").alias("__text")]
    if carry:  # as one column, so that no name can clash
        picked.append(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__rest"))
    narrow = docs.select(*picked)
    typed = narrow.withColumn("__digest", F.lit(b"")).withColumn("__size", F.lit(0).cast("long")).schema
    arrow = to_arrow_schema(typed)
    local = narrow.mapInArrow(_grace(memory, False, arrow), typed)
    return local.repartition("__digest").mapInArrow(_grace(memory, True, arrow), typed)


def winners(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """One row per distinct content: text_sha256, keep_id, group_size."""
    found = _distinct(docs, [], memory)
    return found.select(
        F.lower(F.hex("__digest")).alias("text_sha256"), F.col("__id").alias("keep_id"), F.col("__size").alias("group_size")
    )


def groups(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows meet their group by the SHA-256 of the content; the group itself was made by comparing
    contents. The join is left to Spark, whose adaptive execution splits the part of a hot group.
    """
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(lowered, 256).alias("text_sha256"))
    rows = rows.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("__n"))
    both = rows.join(winners(docs, memory), "text_sha256")
    each = both.select("*", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__k"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__k") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """docs without the copies: the row with the largest doc_id of each content, all columns kept."""
    found = _distinct(docs, [c for c in docs.columns if c != "text"], memory)
    text = F.col("__text").cast("string").alias("text")
    return found.select(*[text if c == "text" else F.col(f"__rest.`{c}`") for c in docs.columns])
