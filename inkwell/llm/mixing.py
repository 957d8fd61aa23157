"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are token shares raised to an exponent and normalised. The exponent, 1 to keep the shares and 0 to level them, is
bisected so that the weights have a target entropy, or nearer to 1 where a source would be repeated more often than allowed.
Every source then runs through whole epochs, each in a keyed pseudo-random order of its documents, and through as much of
one more epoch as its budget of tokens holds. Where that epoch ends is found by adding up tokens over ever finer ranges of
the keys, so no task ever orders a whole source. A document's key and epoch give its place in the stream, which is laid out
in blocks that all hold the sources in proportion. Within a block a second hash permutes the documents of all sources, so that
ordering by block, order and id gives the stream; positioned() numbers the rows of each block that way.

Tokens are words. A null source counts as the source "", and a document without words is placed at no cost. Rows that repeat
an id stand beside each other; those with a null id are placed as one document. An empty table gives an empty stream. Columns
that clash with the ones added stay as they are. The driver holds one row per source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, table, unused

#: Share of the highest possible entropy, and how often a source may be run through.
ENTROPY, REPEATS = 0.98, 2.0
BLOCK_TOKENS = 1 << 20
SEED = 3
#: Bits of the key by which a range is split at each of the first two looks; 4096 ranges at a time.
BITS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weights(tokens: dict[str, int], entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> tuple[float, dict[str, float], float]:
    """The exponent, the weight of each source, and the budget of tokens.

    Without a given budget it is such that the source repeated least is run through once."""
    live = {s: n for s, n in tokens.items() if n > 0}
    total = sum(live.values())

    def at(x: float) -> dict[str, float]:
        raw = {s: (n / total) ** x for s, n in live.items()}
        norm = sum(raw.values())
        return {s: v / norm for s, v in raw.items()}

    def size(w: dict[str, float]) -> float:
        return budget if budget is not None else max(live[s] / w[s] for s in live)

    def fits(x: float) -> bool:
        w = at(x)
        level = -sum(v * math.log(v) for v in w.values() if v > 0) <= entropy * math.log(len(live)) + 1e-12
        return level and max(size(w) * w[s] / live[s] for s in live) <= repeats

    if not live:
        return 1.0, {}, 0.0
    low, high = 0.0, 1.0
    if fits(low):
        high = low
    elif not fits(high):
        low = high  # even the shares as they are ask for more: keep them
    for _ in range(60):
        middle = (low + high) / 2
        if fits(middle):
            high = middle
        else:
            low = middle
    return high, at(high), size(at(high))


def key(epoch: Column) -> Column:
    """A document's place in an epoch, 0 to 2**63 - 1."""
    return F.xxhash64(F.col("doc_id"), epoch.cast("long"), F.lit(SEED)).bitwiseAND(F.lit(2**63 - 1))


def plan(sized: DataFrame, **limits) -> DataFrame:
    """For sized (doc_id, source, tokens): of each source its tokens, weight, quota, whole epochs, and the last key of the
    epoch cut short (-1: none)."""
    spark = sized.sparkSession
    totals = {r.source: r.tokens for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    exponent, share, budget = weights(totals, **limits)
    rows = []
    for source, tokens in sorted(totals.items()):
        quota = share.get(source, 0) * budget
        whole = int(quota / tokens + 1e-9) if tokens else 1
        rows.append((source, tokens, share.get(source, 0.0), quota, whole, max(0, int(quota + 1e-6) - whole * tokens), budget))
    quotas = cut(spark.createDataFrame(rows, "source string, source_tokens long, weight double, quota double, whole long, rest long, budget double"))

    keyed = sized.join(quotas.select("source", "whole", "rest"), "source").select("source", "rest", "tokens", key(F.col("whole")).alias("key"))
    keyed = cut(keyed.where("rest > 0"))
    by_range = Window.partitionBy("source").orderBy("range")
    left, inside = keyed, F.lit(0)
    for look in (1, 2):
        shift = 63 - BITS * look
        ranges = left.groupBy("source", "rest", F.shiftright("key", shift).alias("range")).agg(F.sum("tokens").alias("tokens"))
        ends = F.sum("tokens").over(by_range)  # at most 2**BITS rows of a source
        cuts = cut(ranges.withColumn("over", ends - F.col("rest")).where("over > 0").groupBy("source").agg(F.min_by(F.struct("range", (F.col("tokens") - F.col("over")).alias("rest")), "range").alias("at")).select("source", "at.range", F.col("at.rest").alias("left")))
        left = left.withColumn("range", F.shiftright("key", shift)).join(cuts, ["source", "range"]).select("source", F.col("left").alias("rest"), "tokens", "key")
    taken = F.sum("tokens").over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    last = left.withColumn("taken", taken).where(F.col("taken") <= F.col("rest")).groupBy("source").agg(F.max("key").alias("inside"))
    begin = cuts.select("source", (F.shiftleft("range", shift) - 1).alias("before"))  # of the range that holds the end
    return cut(quotas.join(begin, "source", "left").join(last, "source", "left").select(*(c for c in quotas.columns if c != "rest"), F.when(F.col("rest") == 0, -1).otherwise(F.coalesce("inside", "before", F.lit(-1))).alias("last_key")))


def realise(docs: DataFrame, quotas: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Each row of docs, with all its columns, once for each time it is due, with mix_epoch, mix_key, mix_block and
    mix_order (with an underscore added where docs has a column of that name)."""
    names = {c: unused(f"mix_{c}", docs) for c in ("source", "whole", "last_key", "source_tokens", "quota", "budget", "epoch", "key", "block", "order")}
    q = quotas.select(*(F.col(c).alias(names[c]) for c in ("source", "whole", "last_key", "source_tokens", "quota", "budget")))
    col = lambda c: F.col(names[c])
    due = docs.withColumn(names["source"], F.coalesce("source", F.lit(""))).join(q, names["source"])
    due = due.select("*", F.explode(F.sequence(F.lit(0).cast("long"), col("whole"))).alias(names["epoch"]))
    due = due.withColumn(names["key"], key(col("epoch"))).where((col("epoch") < col("whole")) | (col("key") <= col("last_key")))
    place = F.when(col("quota") > 0, (col("epoch") + col("key") / 2.0**63) * col("source_tokens") / col("quota")).otherwise(col("key") / 2.0**63)
    blocks = F.greatest(F.lit(1.0), F.ceil(col("budget") / block_tokens))
    block = F.floor(F.least(place, F.lit(1 - 1e-12)) * blocks)
    return due.select(*docs.columns, names["epoch"], names["key"], block.alias(names["block"]), key(-1 - col("epoch")).alias(names["order"]))


def positioned(stream: DataFrame) -> DataFrame:
    """What realise gave of docs without clashing columns, with mix_position, a row's place in its block from 0 on. A block has
    some BLOCK_TOKENS words, so no task orders more."""
    rest = [c for c in stream.columns if not c.startswith("mix_")]
    within = Window.partitionBy("mix_block").orderBy("mix_order", "doc_id", "mix_epoch", "mix_key", *(c for c in rest if c != "doc_id"))
    return stream.withColumn("mix_position", F.row_number().over(within) - 1)


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), n_words(F.col("text")).alias("tokens"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens and the epoch, key, block, order and position of every row of the mixed stream."""
    sized = cut(sizes(table(spark, sf_dir, "documents")))
    return positioned(realise(sized, plan(sized)))
