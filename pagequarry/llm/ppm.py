"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is read as its UTF-8 bytes and one end symbol, each predicted from the ORDER symbols before it; what
lies before a text is a symbol of its own, so that a context knows the start. The model is a trie of contexts
with the counts of what followed them in all training documents. A symbol that did not follow the longest
context is an escape (method C: the number of distinct followers over that number and all occurrences) to the
context without its farthest symbol, where the symbols that the longer context knew are excluded; a context
that training never saw is passed without cost, so is one whose symbols are all excluded. Below order 0 the
symbols left over are equally likely. The probabilities of all symbols after a context sum to 1.

The trie is a table for each order: a node is a context and a symbol. Contexts are nested (what follows a
context also follows its shorter one), so the exclusion at an order depends on the next longer context alone.
With that a level needs one join with the level above it (counts, totals and the cost after an escape) and one
window over a context, which holds no more rows than there are symbols. All levels are DataFrames.

A text's score needs the costs of the grams (context and symbol) in it. Documents are dealt to segments of some
SEGMENT bytes; a segment asks for its distinct grams and words once, the trie answers, and the answers meet
the segment's texts in one task, which sums over them. The tables are as large as the corpus asks for; nothing
of them is sent to the driver but sums, or broadcast by force.

The base score is that of a unigram of words with additive smoothing: its counts take the same way.

Defined cases: a null or empty text is its end symbol alone; texts of any length are read whole; a null
doc_id counts as the empty text in the draw of the training part, so that it is held out; repeated rows each
give a row and train each; where no document trains, all symbols are equally likely; an empty table gives an
empty table; columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from pagequarry.llm.common import bucketed, scope, segments, starts_of, stored, tidy

#: Symbols are bytes and the border of a text, its start and its end; a symbol takes BITS bits of a gram's code.
BORDER, SYMBOLS, BITS = 256, 257, 9
#: Symbols that a context holds at most: grams of seven symbols fill a long.
ORDER = 5
#: Bytes of text in a segment, and of those that are coded together.
SEGMENT, PART = 32 << 20, 1 << 20
#: Parts whose counts are held one by one.
PARTS = 6
HELD_OUT = 10
ALPHA = 0.1


# ---------------------------------------------------------------- grams and words of texts
def gram_codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each symbol of the texts, end symbols included, and where each text's grams begin (one more at the end).

    The symbol is in the low bits, the farthest one of its context in the high bits.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = starts_of(lengths)
    # each text with `order` borders before it and one after it
    own = np.ones(int(begins[-1]) + order * len(texts), bool)
    for k in range(order):
        own[begins[:-1] + np.arange(len(texts)) * order + k] = False
    is_byte = own.copy()
    is_byte[begins[1:] + np.arange(1, len(texts) + 1) * order - 1] = False
    wide = np.full(len(own) + order, BORDER, np.int64)
    wide[order:][is_byte] = np.frombuffer(b"".join(texts), np.uint8)
    codes = wide[: len(own)].copy()
    for k in range(order - 1, -1, -1):  # in place: a large array that is new costs more than the work in it
        codes <<= BITS
        codes |= wide[order - k : len(wide) - k]
    return codes[own], begins


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of texts, and where each text's begin."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, cuts = split.flatten(), starts_of(split.value_lengths().to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
    return words.filter(pa.array(some)), starts_of(some)[cuts]


def _dealt(batches):
    """Parts of the rows, each one compressed value with the number of its segment: the task's, and the segment's place in the task."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    used = seg = 0
    for b in segments(batches, 2, PART):
        yield pa.RecordBatch.from_arrays([pa.array([task << 24 | seg], pa.int64()), pa.array([_folded(b)], pa.binary())], names=["seg", "part"])
        used += b.column(2).nbytes
        if used >= SEGMENT:
            used, seg = 0, seg + 1


def _folded(b: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(b)
    return out.getvalue().to_pybytes()


def _unfolded(part: bytes) -> pa.Table:
    """doc_id, held_out, text of a part."""
    table = pa.ipc.open_stream(part).read_all()
    return table.set_column(2, "text", table["text"].cast(pa.large_string())).combine_chunks()


def dealt(docs: DataFrame) -> DataFrame:
    """seg, part of all documents, stored. No segment holds much more than SEGMENT bytes of text, or one text."""
    named = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(named) % HELD_OUT == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(narrow.mapInArrow(tidy(_dealt), "seg long, part binary"), "segments")


def _lean() -> None:
    """From now on what this process frees of arrays over a megabyte goes back to the system at once."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(_MMAP_THRESHOLD, 1 << 20)
    except (OSError, AttributeError):  # not glibc
        pass


#: The parameter's number in malloc.h.
_MMAP_THRESHOLD = -3


def _asked(order: int):
    """seg, gram or word, n: what each segment holds, and how often its training documents do."""

    def run(batches):
        _lean()
        held, at = _Counts(), None
        for b in batches:
            for seg, part in zip(b.column(0).to_pylist(), b.column(1)):
                if at is not None and seg != at:
                    yield from held.batches(at)
                    held = _Counts()
                at = seg
                docs = _unfolded(part.as_buffer())
                held.add(docs["text"].chunk(0) if docs.num_rows else pa.array([], pa.large_string()), ~docs["held_out"].to_numpy(), order)
        if at is not None:
            yield from held.batches(at)

    return tidy(run)


class _Counts:
    """Distinct grams and words of one segment with their training counts: of each part first, then of all parts."""

    def __init__(self):
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: list[pa.Table] = []

    def add(self, texts: pa.Array, trains: np.ndarray, order: int) -> None:
        codes, begins = gram_codes(texts.cast(pa.large_binary()).to_pylist(), order)
        self.grams.append(_sorted_counts(codes, np.repeat(trains, np.diff(begins))))
        words, cuts = _words(texts)
        self.words.append(_counted(words.cast(pa.large_string()), np.repeat(trains, np.diff(cuts))))
        if len(self.grams) > PARTS:
            self.grams, self.words = [_merged(self.grams)], [_summed(self.words)]

    def batches(self, seg: int):
        codes, n = _merged(self.grams)
        grams, words = pa.table({"key": codes, "n": n}), _summed(self.words)
        for keys, columns in ((grams, lambda t: (t["key"], pa.nulls(len(t), pa.string()))), (words, lambda t: (pa.nulls(len(t), pa.int64()), t["key"].cast(pa.string())))):
            for at in range(0, len(keys), 1 << 17):
                some = keys.slice(at, 1 << 17).combine_chunks()
                table = pa.table([pa.array(np.full(len(some), seg)), *columns(some), some["n"]], names=["seg", "gram", "word", "n"])
                yield from table.combine_chunks().to_batches()


def _sorted_counts(codes: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and how many of each train: a sort of numbers, which costs a fraction of a hash table's time."""
    both = codes.view(np.uint64) << np.uint64(1)
    both |= trains
    both.sort()
    keys = (both >> np.uint64(1)).view(np.int64)
    first = _firsts(keys)
    both &= np.uint64(1)
    return keys[first], np.add.reduceat(both.view(np.int64), first)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, n = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(keys, kind="stable")  # of runs that are sorted
    keys = keys[by]
    first = _firsts(keys)
    return keys[first], np.add.reduceat(n[by], first)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each of the sorted keys comes first."""
    return np.concatenate((np.zeros(min(len(keys), 1), np.int64), np.flatnonzero(keys[1:] != keys[:-1]) + 1))


def _counted(keys: pa.Array, trains: np.ndarray) -> pa.Table:
    coded = keys.dictionary_encode()
    index = coded.indices.to_numpy()
    n = np.bincount(index if trains.all() else index[trains], minlength=len(coded.dictionary))
    return pa.table({"key": coded.dictionary, "n": pa.array(n.astype(np.int64))})


def _summed(parts: list[pa.Table]) -> pa.Table:
    if len(parts) == 1:
        return parts[0]
    sums = pa.concat_tables(parts).group_by("key", use_threads=False).aggregate([("n", "sum")])
    return sums.select(["key", "n_sum"]).rename_columns(["key", "n"])


# ---------------------------------------------------------------- the trie
def trie(grams: DataFrame, order: int) -> DataFrame:
    """gram, cost: log10 of the probability of each gram's symbol after its context.

    grams: distinct codes of `order` + 1 symbols with their training counts n (0: asked for only).
    """
    levels = [stored(grams, "grams")]
    for k in range(order - 1, -1, -1):  # without the farthest symbol
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k + 1))) - 1))
        levels.insert(0, stored(levels[0].groupBy(shorter.alias("gram")).agg(F.sum("n").alias("n")), "grams"))
    above = None
    for k, level in enumerate(levels):
        above = stored(_level(level, above, k), "costs")
    return above.select("gram", _cost(F.col("n"), F.col("total") + F.col("distinct"), F.col("distinct"), F.col("escaped")).alias("cost"))


def _cost(n, whole, distinct, escaped):
    """The cost at a context of which `whole` is what its symbols and its escape share; nothing is known where that is 0."""
    return F.when(n > 0, F.log10(n / whole)).when(whole > 0, F.log10(distinct / whole) + escaped).otherwise(escaped)


def _level(level: DataFrame, above: DataFrame | None, order: int) -> DataFrame:
    """gram, n, and of its context total, distinct and the cost of the symbol once the context is escaped from."""
    context = F.shiftright("gram", BITS)
    here = W.partitionBy(context)
    total = F.sum("n").over(here).alias("total")
    distinct = F.count_if(F.col("n") > 0).over(here).alias("distinct")
    if above is None:
        rows = level.select("gram", "n", total, distinct)
        left = F.lit(SYMBOLS) - F.col("distinct")
        return rows.select("*", F.when(left > 0, -F.log10(left)).otherwise(0.0).alias("escaped"))
    suffix = F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1))
    upper = above.select(F.col("gram").alias("suffix"), F.col("n").alias("m"), F.col("total").alias("up_total"), F.col("distinct").alias("up_distinct"), F.col("escaped").alias("up_escaped"))
    both = level.withColumn("suffix", suffix).join(upper, "suffix")
    known = F.sum(F.when(F.col("n") > 0, F.col("m"))).over(here).alias("known")
    rows = both.select("gram", "n", "m", "up_total", "up_distinct", "up_escaped", total, distinct, known)
    left = F.col("up_distinct") - F.col("distinct")
    whole = F.col("up_total") - F.coalesce("known", F.lit(0)) + left
    # a symbol that the context knows is excluded above: its cost after an escape is asked for by no one
    return rows.select("gram", "n", "total", "distinct", _cost(F.col("m"), F.when(whole > 0, whole), left, F.col("up_escaped")).alias("escaped"))


# ---------------------------------------------------------------- scores
def _by_segment(b: pa.RecordBatch):
    """Runs of rows of one segment."""
    seg = b.column("seg").to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(np.diff(seg)) + 1).tolist(), len(seg)]
    for low, high in zip(edges, edges[1:]):
        if high > low:
            yield int(seg[low]), b.slice(low, high - low)


class _Answers:
    """One segment's parts, and what its grams and words are answered, taken from batches as they come."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.codes, self.costs, self.counts = [], [], []
        self.words: list[pa.Array] = [pa.array([], pa.string())]

    def add(self, rows: pa.RecordBatch) -> None:
        gram, word, value = (rows.column(c) for c in ("gram", "word", "value"))
        self.parts += rows.column("part").drop_null().to_pylist()
        self.codes.append(gram.drop_null().to_numpy(zero_copy_only=False).copy())
        self.costs.append(value.filter(gram.is_valid()).to_numpy(zero_copy_only=False).copy())
        self.counts.append(value.filter(word.is_valid()).to_numpy(zero_copy_only=False).copy())
        self.words.append(pa.concat_arrays([word.drop_null()]))

    def scored(self, order: int, share: float, end_count: int):
        codes, costs = np.concatenate(self.codes), np.concatenate(self.costs)
        by = np.argsort(codes)
        codes, costs = codes[by], costs[by]
        self.codes = self.costs = None
        for part, words in zip(self.parts, self._word_counts()):
            docs = _unfolded(part)
            n_tokens, n_known, base, score = _document_sums(docs["text"].chunk(0), order, codes, costs, *words, share, end_count)
            own = {"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": score}
            yield from pa.table(own).combine_chunks().to_batches()

    def _word_counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each part, the training count of each of its words and where each text's begin. All parts' distinct words are looked up at once."""
        coded, cuts = [], []
        for part in self.parts:
            words, at = _words(_unfolded(part)["text"].chunk(0))
            coded.append(words.dictionary_encode())
            cuts.append(at)
        known = pa.concat_arrays(self.words).cast(pa.large_string())
        place = pc.index_in(pa.concat_arrays([c.dictionary.cast(pa.large_string()) for c in coded]), known).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.concatenate(self.counts)[place] if len(place) else np.zeros(0)
        self.words = self.counts = None
        each = np.split(counts, np.cumsum([len(c.dictionary) for c in coded])[:-1])
        return [(n[c.indices.to_numpy()], at) for n, c, at in zip(each, coded, cuts)]


def _scored(order: int, share: float, end_count: int):
    """Per document: tokens, known ones, base score and score. Rows are sorted by segment."""

    def run(batches):
        _lean()
        held, at = _Answers(), None
        for b in batches:
            for seg, rows in _by_segment(b):
                if at is not None and seg != at:
                    yield from held.scored(order, share, end_count)
                    held = _Answers()
                at = seg
                held.add(rows)
        if at is not None:
            yield from held.scored(order, share, end_count)

    return tidy(run)


def _document_sums(texts: pa.Array, order, codes, costs, c: np.ndarray, cuts: np.ndarray, share, end_count):
    """n_tokens, n_known, base score and score of each text; c: the training count of each of the words, cuts: where each text's begin."""
    grams, begins = gram_codes(texts.cast(pa.large_binary()).to_pylist(), order)
    coded = pa.array(grams).dictionary_encode()
    asked = coded.dictionary.to_numpy()
    by = np.argsort(asked)  # looked up in order: each place is near the last
    found = np.empty(len(asked))
    found[by] = costs[np.searchsorted(codes, asked[by])]
    cost = found[coded.indices.to_numpy()]
    score = np.add.reduceat(cost, begins[:-1])  # no text is without its end symbol
    sums = [_sums(x, cuts) for x in (np.ones(len(c)), c > 0, np.log10(c + ALPHA))]
    n_tokens, n_known = sums[0].astype(np.int64) + 1, sums[1].astype(np.int64) + (end_count > 0)
    base = sums[2] + math.log10(end_count + ALPHA) + n_tokens * share
    return n_tokens, n_known, base, score


def _sums(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(cuts) - 1)
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        out[some] = np.add.reduceat(x.astype(float), cuts[:-1][some])
    return out


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    keep: list[DataFrame] = []
    with scope(keep):
        texts = dealt(docs)
        spark = docs.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        asked = texts.mapInArrow(_asked(order), "seg long, gram long, word string, n long")
        asked = asked.select("seg", F.coalesce("gram", F.xxhash64("word")).alias("key"), "word", "n").repartition(buckets, "key")
        asked = bucketed(asked, "asked", "key", buckets)  # counted and answered without another shuffle
        words = stored(asked.where("word is not null").groupBy("key", "word").agg(F.sum("n").alias("c")), "words")
        n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
        grams = asked.where("word is null").groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("n"))
        costs = trie(grams, order)
        ends = asked.where(F.col("word").isNull() & (F.col("key").bitwiseAND(F.lit((1 << BITS) - 1)) == BORDER)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        n, v = n + ends, v + (ends > 0)
        answered = asked.where("word is null").select("seg", "key").join(costs.withColumnRenamed("gram", "key"), "key")
        answered = answered.select("seg", F.col("key").alias("gram"), F.lit(None).cast("string").alias("word"), F.col("cost").alias("value"))
        named = asked.where("word is not null").select("seg", "key", "word").join(words, ["key", "word"])
        named = named.select("seg", F.lit(None).cast("long").alias("gram"), "word", F.col("c").cast("double").alias("value"))
        answers = answered.unionByName(named)
        share = -math.log10(n + ALPHA * (v + 1))
        out = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
        both = answers.withColumn("part", F.lit(None).cast("binary")).unionByName(texts, allowMissingColumns=True)
        found = stored(both.repartition("seg").sortWithinPartitions("seg").mapInArrow(_scored(order, share, ends), out), "scores")
        keep.append(found)
    return found.withColumn("train_tokens", F.lit(n).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
