"""Near copies by resemblance: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates share a band, ROWS min-hashes in a row of BANDS times as many: a pair at 0.8 is missed by all bands with a
chance of 0.002. Candidates are verified on their whole sets. Within a band's bucket the texts are compared with the
leader, that of least number; what is near the leader leaves the bucket with it. A group of thousands of near copies
costs one comparison a copy. When a turn leaves more than half of the rows, they share bands but are mostly not near:
these buckets are compared pair by pair, in blocks of BLOCK rows, with one row a block and partner block, not one a
pair. No bucket is cut off, and no bucket is one task.

Of each component one row stays, that of the least doc_id. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text of
fewer than five words has itself as its one shingle.

Defined cases: a null text and one without words have no shingles and are near nothing; a text of any length is read
whole; a null doc_id is larger than any other; of rows that tie in doc_id the one of least text hash stays; rows that
repeat a text are near; an empty table gives an empty table; other columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import bucketed, components, discard, free_name, multipliers, scope, stored, tidy

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 6
#: Shingles that are hashed together.
AT_ONCE = 2048
#: Rows of a block of a bucket whose rows are near no leader, and shingles whose counts two blocks share at a time.
BLOCK, STRIP = 64, 4096


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        starts, stops = [0], [len(joined)]
    else:
        starts, stops = np.concatenate(([0], ends[:-size] + 1)).tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, stops)), np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> list[int]:
    """A hash of each band of a set's min-hashes."""
    by = multipliers(BANDS * ROWS, 11)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), AT_ONCE):
        mixed = hashes[at : at + AT_ONCE, None] * by
        mixed ^= mixed >> np.uint64(29)
        mixed *= by[::-1]
        np.minimum(least, mixed.min(axis=0), out=least)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _banded(batches):
    for b in batches:
        sets = [shingles(t) for t in b.column(1).to_pylist()]
        keys = [bands(s) if len(s) else [] for s in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["row", "bands"])


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the texts' sets are similar; the rows of one leader, a, follow each other."""
    last, held, out = None, None, []
    for x, y in zip(a, b):
        if last is None or x != last:
            last, held = x, shingles(x)
        other = shingles(y)
        both = len(np.intersect1d(held, other, assume_unique=True))
        out.append(both >= SIMILAR * (len(held) + len(other) - both))
    return pd.Series(out, dtype=bool)


def links(texts: DataFrame) -> DataFrame:
    """a, b: verified pairs that connect the near texts of a stored table (row, text); rows are distinct longs.

    The table is joined with each turn's pairs: in buckets by row it is not shuffled for that.
    """
    keep: list[DataFrame] = []
    with scope(keep):
        banded = texts.select("row", "text").mapInArrow(tidy(_banded), "row long, bands array<long>")
        members = banded.select("row", F.explode("bands").alias("key"))
        left = stored(_shared(stored(members, "bands")), "buckets")
        found, n = None, left.count()
        while n:
            leaders = left.groupBy("key").agg(F.min("row").alias("leader"))
            pairs = left.join(leaders, "key").where("row > leader").select("row", "leader").distinct()
            one = texts.select(F.col("row"), F.col("text").alias("own"))
            two = texts.select(F.col("row").alias("leader"), F.col("text").alias("other"))
            checked = pairs.join(one, "row").join(two, "leader").select("row", "leader", _similar("other", "own").alias("near"))
            near = stored(checked.where("near").select(F.col("row").alias("a"), F.col("leader").alias("b")), "checked")
            found = near if found is None else found.unionByName(near)
            # a bucket goes on without its leader and what is near it
            named = left.join(leaders, "key").where("row > leader")
            old, before = left, n
            left = stored(_shared(named.join(near.toDF("row", "leader"), ["row", "leader"], "left_anti").select("row", "key")), "buckets")
            n = left.count()
            discard(old)
            if 2 * n > before:
                break
        if n:
            found = found.unionByName(_rest(left, texts))
        none = texts.select(F.col("row").alias("a"), F.col("row").alias("b")).where("false")
        found = stored(none if found is None else found, "near")
        keep.append(found)
    return found


def blocks(members: DataFrame) -> DataFrame:
    """row, pair, side: the rows of each bucket cut into blocks of some BLOCK rows, once for each pair of blocks (or of one with itself).

    Every two rows of a bucket meet under one pair. A pair is a small group, so neither a bucket nor its rows are one task's.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")))
    each = own.select("key", "row", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return each.select("row", F.struct("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).alias("pair"), (F.col("own") < F.col("other")).alias("side"))


def _rest(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of what is in buckets where most are near no leader: all pairs of a bucket, block by block."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = stored(blocks(members).select("row", F.xxhash64("pair").alias("pair")), "blocks").join(texts.select("row", "text"), "row")
    return met.repartition(n, "pair").sortWithinPartitions("pair").mapInArrow(tidy(_compared), "a long, b long").distinct()


def _compared(batches):
    """Rows sorted by pair -> verified links. The rows of a pair may go over the end of a batch."""
    at, rows, sets = None, [], []
    for b in batches:
        for row, pair, text in zip(*(b.column(c).to_pylist() for c in ("row", "pair", "text"))):
            if pair != at:
                yield _near(rows, sets)
                at, rows, sets = pair, [], []
            rows.append(row)
            sets.append(shingles(text))
    yield _near(rows, sets)


def _near(rows: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    """The links among a pair's rows; what they share is counted for STRIP shingles at a time."""
    sizes = np.array([len(s) for s in sets], np.int64)
    names, which = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(which, kind="stable")
    which, owner = which[by], owner[by]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, len(names), STRIP):
        here = slice(*np.searchsorted(which, (low, low + STRIP)))
        held = np.zeros((len(sets), STRIP), np.float32)
        held[owner[here], which[here] - low] = 1
        both += held @ held.T
    a, b = np.nonzero(np.triu(both >= SIMILAR * (sizes[:, None] + sizes[None, :] - both), 1))
    a, b = (np.array(rows, np.int64)[x] for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def _shared(members: DataFrame) -> DataFrame:
    """row, key of the buckets that hold more than one row."""
    many = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return members.join(many, "key").select("row", "key")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near texts."""
    row = free_name(docs, "__row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keep: list[DataFrame] = [numbered]
    with scope(keep):
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        texts = bucketed(numbered.select(F.col(row).alias("row"), "text").repartition(n, "row"), "texts", "row", n)
        roots = stored(components(links(texts)), "roots")
        named = roots.join(numbered.select(F.col(row).alias("vertex"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h")), "vertex")
        first = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "vertex")).alias("s"))
        stays = first.select("root", F.col("s.vertex").alias("stay"))
        gone = stored(roots.join(stays, "root").where("vertex <> stay").select(F.col("vertex").alias(row)), "gone")
        keep.append(gone)
    return numbered.join(gone, row, "left_anti").drop(row)
