"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two link at 2 or fewer differing bits. Cut into 2 segments, one of the
segments differs by at most one bit, so the two share a segment with one bit left out: each distinct
fingerprint is indexed under 2 x 32 such variants, rows with the same variant are brought together by
an equality shuffle, and candidates are verified on all 64 bits. Links are reduced to a star per
bucket before they leave the task, and components are found by contraction.

Defined cases: a null text and a text without words have fingerprint zero, linked like any other; a text
of any length is hashed whole; a bit set in just half of the hashes is 0; a null doc_id is never a
component's smallest id unless all are null; repeated rows each give a row; an empty table gives an empty
table; other columns are ignored by `components_of` and kept by `deduplicate`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pagequarry.llm.common import components, free_name, scope, stored, tidy

BITS, SEGMENT, LINK = 64, 32, 2
SHINGLE, SEED = 3, 42
#: Buckets up to this size compare their pairs; larger ones look up each of the possible partners of a
#: member. Both find the same links.
PAIRS_UP_TO = 48


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space of ASCII
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        starts, stops = [0], [len(joined)]
    else:
        starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
        stops = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * ones > len(h))
    value = sum(1 << int(i) for i in set_bits)
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(batches):
    for b in batches:
        made = [fingerprint(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(made, pa.int64())], names=[*b.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, more, fp (the 64 bits as a long) of every document."""
    narrow = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *more)
    out = ", ".join(f"{c} {t}" for c, t in narrow.dtypes[1:])
    return narrow.mapInArrow(tidy(_fingerprints), f"{out}, fp long")


# ---------------------------------------------------------------- links
def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _accept(a: np.ndarray, b: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Linked, and sig is the one variant under which this pair counts: a link is found once."""
    x = a ^ b
    low, high = _popcount(x & np.uint64(0xFFFFFFFF)), _popcount(x >> np.uint64(32))
    k = sig >> np.uint64(32)  # 0-63: segment and wildcard
    bit = np.uint64(1) << k
    first = low <= 1  # found under the low segment, else under the high one
    own = np.where(first, low, high)
    side = np.where(first, k < 32, k >= 32)
    at = np.where(own == 1, (x & bit) != 0, (k & np.uint64(31)) == 0)
    return (low + high <= LINK) & side & at


def _neighbours(fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among the members of one large bucket: each member's possible partners are looked up."""
    fps = np.unique(fps)
    wild = 1 << k
    other = range(32, 64) if k < 32 else range(32)
    masks = [wild, *(1 << i for i in other), *(wild | 1 << i for i in other)]
    masks += [1 << i | 1 << j for i in other for j in other if i < j]
    left, right = [], []
    for m in masks:
        want = fps ^ np.uint64(m)
        at = np.minimum(np.searchsorted(fps, want), len(fps) - 1)
        hit = (fps[at] == want) & (fps < want)
        left.append(fps[hit])
        right.append(want[hit])
    return np.concatenate(left), np.concatenate(right)


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge per vertex, to the least member."""
    names, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.arange(len(names)) != root
    return names[own], names[root[own]]


def _links(batches):
    """Rows sorted by sig: sig, fp -> edges. A bucket may go over the end of a batch."""
    rest_sig, rest_fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for b in (*batches, None):
        if b is None:
            sig, fp, cut = rest_sig, rest_fp, len(rest_sig)
        else:
            sig = np.concatenate((rest_sig, b.column("sig").to_numpy(zero_copy_only=False).view(np.uint64)))
            fp = np.concatenate((rest_fp, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(sig):
                continue
            cut = int(np.searchsorted(sig, sig[-1]))
            rest_sig, rest_fp = sig[cut:], fp[cut:]
        a, c = _bucket_links(sig[:cut], fp[:cut])
        if len(a):
            a, c = _star(a, c)
            arrays = [pa.array(a.view(np.int64)), pa.array(c.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])


def _bucket_links(sig: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.uint64)
    if len(sig) < 2:
        return none, none
    starts = np.concatenate(([0], np.flatnonzero(sig[1:] != sig[:-1]) + 1))
    sizes = np.diff(np.concatenate((starts, [len(sig)])))
    left, right = [none], [none]
    for s, n in zip(starts[sizes > PAIRS_UP_TO], sizes[sizes > PAIRS_UP_TO]):
        a, b = _neighbours(fp[s : s + n], int(sig[s]) >> 32)
        left.append(a)
        right.append(b)
    small = np.repeat((sizes > 1) & (sizes <= PAIRS_UP_TO), sizes)
    sig, fp = sig[small], fp[small]
    for d in range(1, PAIRS_UP_TO):
        if len(sig) <= d:
            break
        same = np.flatnonzero(sig[d:] == sig[:-d])
        if not len(same):
            break
        a, b = fp[same], fp[same + d]
        ok = _accept(a, b, sig[same])
        left.append(a[ok])
        right.append(b[ok])
    return np.concatenate(left), np.concatenate(right)


def variants(fps: DataFrame) -> DataFrame:
    """sig, fp: each fingerprint under its 2 x 32 one-wildcard segments (k in the high half of sig)."""
    each = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("k"))
    half = F.expr("CASE WHEN k < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END")
    masked = half.bitwiseAND(F.expr("~shiftleft(1L, k % 32)"))
    return each.select(F.expr("shiftleft(CAST(k AS BIGINT), 32)").bitwiseOR(masked).alias("sig"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) of distinct fingerprints that connect all that are linked."""
    return variants(fps).repartition("sig").sortWithinPartitions("sig").mapInArrow(_links, "a long, b long").distinct()


def _named(prints: DataFrame) -> DataFrame:
    """fp, root, component_id for each distinct fingerprint of a stored table of them.

    Both sides of each join are stored tables, so that their shuffles are plain and adaptive execution
    can split the part of a large component.
    """
    keep: list[DataFrame] = []
    with scope(keep):
        distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
        roots = components(links(distinct.select("fp"))).withColumnRenamed("vertex", "fp")
        linked = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
        linked = stored(linked, "linked")
        least = stored(linked.groupBy("root").agg(F.min("low").alias("component_id")), "least")
        named = stored(linked.join(least, "root").select("fp", "root", "component_id"), "components")
        keep.append(named)
    return named


def components_of(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id."""
    prints = stored(fingerprints(docs), "fingerprints")
    return prints.join(_named(prints), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; all columns kept.

    Where different texts have that doc_id, the one whose hash is least stays; of rows that repeat both
    doc_id and text one stays. A row without a doc_id can't be named as the one that stays: such rows are
    kept, once per text.
    """
    prints = stored(fingerprints(docs, F.xxhash64("text").alias("h")), "fingerprints")
    rows = prints.where("doc_id is not null").join(_named(prints), "fp")
    stays = rows.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("s")).select("s.*")
    keep = stored(stays, "stays")
    i, h = free_name(docs, "__keep_id"), free_name(docs, "__keep_hash")
    keep = keep.select(F.col("doc_id").alias(i), F.col("h").alias(h))
    named = docs.where("doc_id is not null")
    same = (named["doc_id"].cast("long") == F.col(i)) & (F.xxhash64(named["text"]) == F.col(h))
    kept = named.join(keep, same)
    if _repeats(prints):
        kept = kept.dropDuplicates([i, h])
    return kept.drop(i, h).unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def _repeats(prints: DataFrame) -> bool:
    """Whether any rows share doc_id and text."""
    return not prints.where("doc_id is not null").groupBy("doc_id", "h").count().where("count > 1").isEmpty()
