"""Sharding by a k-d tree over document metadata.

The corpus is split again and again at a weighted median (the weight is the size of a row) along the
dimension in which the part is widest, until there is one part per shard. Dimensions are the language,
the source, the size and the place in the order of doc_ids; a part that is to give m shards is cut at
m // 2 of m of its weight. Documents with equal texts form a group that takes the metadata of its
smallest doc_id, so a group stays in one shard unless a cut has to go through it; then it is cut by
doc_id, so that a group of a third of all rows leaves the shards equal.

Medians are found on the executors: a histogram of BINS bins per part is summed, the bin that holds the
median is cut into bins again, and so on until what the bin holds is within TOLERANCE of the part. The
driver sees bins only, at most shards x BINS numbers a pass.

Law `bytes`: sizes are near equal.

Defined cases: a null text has size 8 and no bytes, and counts as equal to an empty one; a text of any
length is one row and never cut; null metadata count as a value of their own; rows that repeat, also
with equal doc_ids, are placed row by row, and a cut may go through them; where values tie the order is
that of a hash of the text, then doc_id, then a number given to each row; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pagequarry.llm.common import SALT, discard, gapless, salted, stored

SHARDS = 24
BINS = 4096
TOLERANCE = 1 / 4000
#: Values of a dimension: 24 bits.
SCALE = 1 << 24
DIMS = ("d_lang", "d_source", "d_size", "d_order")
#: What tells rows apart where a cut goes through one value of a dimension.
TIES = ("__tie", "__id", SALT)


def _metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions as longs below SCALE, and __tie, equal for equal texts."""
    for c in ("lang", "source"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    code = lambda c: F.shiftright(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), 8)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 8).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("__h"),
        code("lang").alias("d_lang"),
        code("source").alias("d_source"),
    )
    rows = stored(rows, "metadata")
    key = ["__h", "text_crc32", "size"]
    first = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("i"), "d_lang", "d_source")
    # Stored, so that both sides of the join have plain shuffles: a hot group's rows are split then.
    groups = stored(rows.groupBy(*key).agg(F.min(first).alias("g")), "text-groups")
    both = rows.select("doc_id", *key).join(groups, key)
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, span = low or 0, max(1, (high or 0) - (low or 0))
    place = ((F.least(F.col("g.i"), F.lit(low + span)) - low).cast("double") / span * (SCALE - 1)).cast("long")
    placed = salted(
        both.select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("g.d_lang").alias("d_lang"),
            F.col("g.d_source").alias("d_source"),
            (F.log2(F.col("size").cast("double")) * (SCALE // 64)).cast("long").alias("d_size"),
            place.alias("d_order"),
            F.pmod(F.xxhash64("__h", "text_crc32"), F.lit(SCALE)).alias("__tie"),
            F.coalesce("doc_id", F.lit(low)).alias("__id"),
        ),
        "places",
    )
    discard(rows, groups)
    return placed


class Cut:
    """Rows go left if (dimension, __tie, __id, salt) comes before (values), as far as values are given."""

    def __init__(self, dim: str, values: tuple[int, ...]):
        self.fields, self.values = (dim, *TIES)[: len(values)], values

    def left(self) -> Column:
        test = F.lit(False)
        for f, v in reversed(list(zip(self.fields, self.values))):
            test = (F.col(f) < v) | ((F.col(f) == v) & test)
        return test


def _choose(n_by_part: dict[int, Column], part: Column) -> Column:
    """A different expression for each part."""
    return reduce(lambda e, p: e.when(part == p[0], p[1]), n_by_part.items(), F.when(F.lit(False), F.lit(None)))


def _cuts(rows: DataFrame, want: dict[int, float]) -> dict[int, Cut]:
    """For each part a cut with a share `want` of its weight on the left."""
    rows = rows.where(F.col("__part").isin(*want))
    stats = rows.groupBy("__part").agg(
        F.sum("size").alias("w"), *[f(d).alias(f"{n}_{d}") for d in (*DIMS, *TIES) for n, f in (("lo", F.min), ("hi", F.max))]
    )
    stats = {r["__part"]: r.asDict() for r in stats.collect()}
    if not stats:
        return {}
    whole = {d: max(1, max(s[f"hi_{d}"] for s in stats.values()) - min(s[f"lo_{d}"] for s in stats.values())) for d in DIMS}
    state = {}
    for p, s in stats.items():
        dim = max(DIMS, key=lambda d: (s[f"hi_{d}"] - s[f"lo_{d}"]) / whole[d])
        state[p] = {"dim": dim, "at": 0, "fixed": (), "lo": s[f"lo_{dim}"], "hi": s[f"hi_{dim}"], "before": 0, "goal": want[p] * s["w"], "w": s["w"]}
    done: dict[int, Cut] = {}
    while state:
        tests, bins = {}, {}
        for p, s in state.items():
            fields = (s["dim"], *TIES)
            x = F.col(fields[s["at"]])
            s["step"] = max(1, -(-(s["hi"] - s["lo"] + 1) // BINS))
            tests[p] = reduce(lambda a, b: a & b, [F.col(f) == v for f, v in zip(fields, s["fixed"])], x.between(s["lo"], s["hi"]))
            bins[p] = F.floor((x - s["lo"]) / s["step"]).cast("long")
        col = F.col("__part")
        picked = rows.where(_choose(tests, col)).select("__part", "size", _choose(bins, col).alias("bin"))
        found: dict[int, list[tuple[int, int]]] = {}
        for r in picked.groupBy("__part", "bin").agg(F.sum("size").alias("w")).collect():
            found.setdefault(r["__part"], []).append((r["bin"], r["w"]))
        for p, s in list(state.items()):
            run = s["before"]
            for b, w in sorted(found[p]):
                if run + w >= s["goal"]:
                    break
                run += w
            lo = s["lo"] + b * s["step"]
            if w <= max(TOLERANCE * s["w"], 1):  # the nearer side of the bin
                near = lo if s["goal"] - run <= run + w - s["goal"] else lo + s["step"]
                done[p] = Cut(s["dim"], (*s["fixed"], near))
                del state[p]
                continue
            s["before"] = run
            if s["step"] > 1:
                s["lo"], s["hi"] = lo, lo + s["step"] - 1
            elif s["at"] < len(TIES):  # one value: go on in the next field
                s["fixed"], s["at"] = (*s["fixed"], lo), s["at"] + 1
                s["lo"], s["hi"] = (stats[p][f"{n}_{TIES[s['at'] - 1]}"] for n in ("lo", "hi"))
            else:  # one row
                near = lo if s["goal"] - run <= run + w - s["goal"] else lo + 1
                done[p] = Cut(s["dim"], (*s["fixed"], near))
                del state[p]
    return done


def tree(rows: DataFrame, shards: int) -> DataFrame:
    """rows of `_metadata` with their shard in __part. A level's parts are stored, so plans stay small."""
    leaves: dict[int, int] = {0: shards}  # first shard of a part -> how many it gives
    rows = rows.withColumn("__part", F.lit(0))
    while any(m > 1 for m in leaves.values()):
        cuts = _cuts(rows, {p: (m // 2) / m for p, m in leaves.items() if m > 1})
        part = F.col("__part")
        right = {p: F.when(c.left(), p).otherwise(p + leaves[p] // 2) for p, c in cuts.items()}
        if right:
            old, rows = rows, stored(rows.withColumn("__part", F.coalesce(_choose(right, part), part).cast("int")), "parts")
            discard(old)
        leaves = {q: n for p, m in leaves.items() for q, n in (((p, m // 2), (p + m // 2, m - m // 2)) if m > 1 else ((p, m),))}
    return rows


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = _metadata(docs)
    placed = tree(rows, shards).select("doc_id", "size", "text_crc32", F.col("__part").alias("shard"), SALT)
    slotted = gapless(placed, ["shard"], ["doc_id", "text_crc32"], "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
