"""Helpers that the corpus operators share: word caches, distributed ranks, components, the library's durable tables."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from pagequarry.sources.tables import bucketed, discard, scope, shared_dir, stored  # noqa: F401

#: Bytes that separate words: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# ---------------------------------------------------------------- memory of a task
def tidy(run):
    """A mapInArrow function that gives its memory back to the system when its input ends.

    Spark uses a Python worker again for other tasks; what it keeps would add up over an application.
    """

    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return tidied


def segments(batches, text: int, size: int, rows: int = 1 << 20):
    """The input as batches of about `size` bytes of text (column number `text`), whatever its own batches are."""
    held: list[pa.RecordBatch] = []
    used = n = 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, base + size - used)) + 1
            end = max(at + 1, min(end, b.num_rows, at + rows - n))
            held.append(b.slice(at, end - at))
            used += int(ends[end - 1]) - base
            n += end - at
            at = end
            if used >= size or n >= rows:
                yield _joined(held)
                held, used, n = [], 0, 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def gather(values: pa.Array, index: np.ndarray, cuts: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of values[index] one after another, and where the parts cut[i]:cut[i + 1] of index begin there."""
    taken = values.take(pa.array(index))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    return memoryview(data) if data is not None else memoryview(b""), at[cuts]


def packed_ids(ids: np.ndarray, cuts: np.ndarray) -> pa.LargeBinaryArray:
    """Runs of 32-bit ids as binary values, for `gather`."""
    offsets = np.ascontiguousarray(cuts, np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def starts_of(lengths) -> np.ndarray:
    """0 and the running sums."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


# ---------------------------------------------------------------- words
class WordCache(dict):
    """word -> compute(word), kept for the words seen last; two generations bound its size."""

    def __init__(self, compute, size: int = 300_000):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


def word_hashes(words: list[bytes], cache: WordCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def hash_cache(seed: int = 0, size: int = 300_000) -> WordCache:
    return WordCache(lambda w: xxhash.xxh3_64_intdigest(w, seed), size)


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    return np.array([xxhash.xxh3_64_intdigest(b"m%d" % i, seed) | 1 for i in range(n)], np.uint64)


def window_hashes(h: np.ndarray, k: int, by: np.ndarray) -> np.ndarray:
    """A multilinear hash of each run of k word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * by[0]
    for i in range(1, k):
        out += h[i : i + n] * by[i]
    return out ^ (out >> np.uint64(31))


# ---------------------------------------------------------------- numbers without gaps
SALT = "__salt"


def salted(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """df stored with a number of its own for each row, for `gapless`."""
    return stored(df.withColumn(SALT, F.monotonically_increasing_id()), what, compression)


def gapless(df: DataFrame, within: list[str], order: list[str], out: str, rows_a_slice: int = 200_000) -> DataFrame:
    """Number the rows of each `within` group from 0 without gaps, no group in one task.

    df must be a table stored by `salted` (it is read twice). Rows are dealt to slices by a hash of their
    salt, so that rows which repeat each other are dealt as evenly as others; the rows of a slice are
    numbered by a window and the slices' counts, of which there are groups x slices, give the offsets.
    """
    n = df.count()
    slices = max(1, -(-n // rows_a_slice)) * 8
    cut = df.withColumn("__slice", F.pmod(F.xxhash64(SALT), F.lit(slices)).cast("int"))
    counts = cut.groupBy(*within, "__slice").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*within).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*within, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    keys = [*within, "__slice"]
    ranked = cut.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order, SALT)) - 1)
    ranked = ranked.join(counts, keys).withColumn(out, F.col("__base") + F.col("__rank"))
    return ranked.drop("__base", "__rank", "__slice", SALT)


# ---------------------------------------------------------------- connected components
def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for each vertex of `edges` (longs): randomised contraction.

    In a round every vertex joins the neighbour (or itself) of least hash, a min that is combined
    before the shuffle; edges are rewritten to what their ends joined, loops and repeats go. The
    edges shrink by a constant factor a round in expectation, chains too. Each round is stored, and
    nothing but a row count reaches the driver.
    """
    links = stored(
        edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links"
    )
    roots = None
    turn = 0
    while not links.isEmpty():
        keep: list[DataFrame] = []
        old = links, roots
        with scope(keep):
            links, roots = _contracted(links, roots, turn)
            keep += [links, roots]
        discard(*old)
        turn += 1
    if roots is None:
        return links.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return roots


def _contracted(links: DataFrame, roots: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round: the rewritten edges, and the roots of all vertices so far."""
    order = lambda c: F.xxhash64(F.lit(turn), c)
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy("a").agg(F.min(F.struct(order(F.col("b")).alias("o"), F.col("b").alias("v"))).alias("m"))
    here = F.struct(order(F.col("a")).alias("o"), F.col("a").alias("v"))
    joined = stored(best.select("a", F.least(F.col("m"), here)["v"].alias("p")), "joined")
    if roots is None:
        roots = joined.select(F.col("a").alias("vertex"), F.col("p").alias("root"))
    else:
        moved = joined.select(F.col("a").alias("root"), "p")
        roots = roots.join(moved, "root", "left").select("vertex", F.coalesce("p", "root").alias("root"))
    one = links.join(joined, "a").select(F.col("p").alias("pa"), F.col("b").alias("a"))
    two = one.join(joined, "a").select("pa", F.col("p").alias("pb")).where("pa <> pb")
    links = stored(two.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    return links, stored(roots, "roots")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


# ---------------------------------------------------------------- words of many texts at once
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE)] = False
#: Bytes that are hashed at a time.
_STRIDE = 1 << 18


class TextWords:
    """The words of a column of texts, as byte ranges of its buffer; no object per word.

    start, stop: byte range of each word in data; first: index of each text's first word (one more at
    the end); a null text has no words.
    """

    def __init__(self, texts):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base, end = (int(at[0]), int(at[-1])) if len(texts) else (0, 0)
        self.data = np.frombuffer(data, np.uint8)[base:end] if end > base else np.zeros(0, np.uint8)
        self.offsets = at - base if len(texts) else np.zeros(1, np.int64)
        inside = _IS_WORD[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]  # a text ends a word
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.stop = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words of a text with single spaces between, and where each word begins and ends: runs of its words are slices."""
        keep = _IS_WORD[self.data]
        after = self.stop[self.stop < len(self.data)]
        after = after[~keep[after]]  # none where the next text begins with a word
        keep[after] = True
        out = self.data[keep]
        out[~_IS_WORD[out]] = SPACE[0]
        lengths = self.stop - self.start
        start = starts_of(lengths)[:-1] + np.searchsorted(after, self.start)
        return out.tobytes(), start, start + lengths

    def hashes(self, seed: int) -> np.ndarray:
        """64 bits of each word: a polynomial over random byte values, mixed. Equal words have equal hashes; others may too."""
        values, step, back, mix = _hash_tables(seed)
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            low = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.stop, low + _STRIDE, side="right")))
            size = int(self.stop[j - 1]) - low
            power, inverse = _powers(seed, size)
            sums = np.empty(size + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values[self.data[low : low + size]] * power[:size], out=sums[1:])
            s = self.start[i:j] - low
            out[i:j] = (sums[self.stop[i:j] - low] - sums[s]) * inverse[s]
            i = j
        out += (self.stop - self.start).astype(np.uint64) * mix
        out ^= out >> np.uint64(32)
        out *= mix
        return out ^ (out >> np.uint64(29))


_TABLES: dict[int, tuple] = {}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _hash_tables(seed: int) -> tuple:
    if seed not in _TABLES:
        step = xxhash.xxh3_64_intdigest(b"step", seed) & ~7 | 5
        mix = xxhash.xxh3_64_intdigest(b"mix", seed) | 1
        values = np.array([xxhash.xxh3_64_intdigest(b"b%d" % b, seed) for b in range(256)], np.uint64)
        _TABLES[seed] = values, step, pow(step, -1, 1 << 64), np.uint64(mix)
    return _TABLES[seed]


def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = _POWERS.get(seed)
    if found is None or len(found[0]) < size:
        _, step, back, _ = _hash_tables(seed)
        n = max(size, _STRIDE + 1)
        made = []
        for r in (step, back):
            p = np.full(n, r, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        found = made[0], made[1]
        if n > 4 * _STRIDE:  # for one huge word only
            return found
        _POWERS[seed] = found
    return found
