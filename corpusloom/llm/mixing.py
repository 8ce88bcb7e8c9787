r"""Mixing sources to target weights by temperature, in block permutations.

Source weights are token shares to the power alpha, normalised: 1 keeps the
shares, 0 makes sources equal. alpha is bisected, BISECTIONS halvings of
[0, 1], to the least value that keeps every source's repetition within
`max_repeat`, or to the value that brings the entropy down to `entropy` bits;
this may lie over 1, and the range is then doubled first. A limit that no alpha
meets raises a ValueError. The budget is given
in tokens, or is the least in which every source passes once at least, so that
no document is lost; each source gets floor(weight * budget + 0.5) tokens of it,
and never less than one pass in the latter case.

A source is read in epochs. Each epoch orders the source's blocks by a hash of
seed, epoch, source and block, and the documents in a block by a hash of seed,
epoch and id. Epochs before the last are whole; the last takes blocks in order
while tokens are left, and of the block in which they run out the documents
that begin before that point.

A document's tokens are its words [^\x20\x09-\x0D]+ and an end. Blocks come
from a hash of the id and hold BLOCK documents, about, so a source that a third
of all rows share is many blocks; windows run over one block's documents, over
the blocks of a source whose turns begin alike, or over the 4,096 beginnings
of a source. The driver holds one row per source.

A null source is a source of its own; null and empty texts count one token;
rows with a null id go by a hash of their text. Repeated rows are mixed each; among
rows of one id the order is that of their texts. An empty table gives an empty
result. Columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import staged

BLOCK = 1000
BISECTIONS = 50
LARGEST = 1024.0  # exponents beyond are not tried
RANGE_DIGITS = 3  # hex digits of a block's turn that its range has: 4,096 ranges
SEED = 17
MAX_REPEAT = 2.0
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("n_tokens", "epoch", "block", "place")


@dataclass
class Source:
    name: str | None
    docs: int
    tokens: int
    weight: float = 0.0
    quota: int = 0


def weights(tokens: list[int], alpha: float) -> list[float]:
    """Normalised powers of token shares."""
    total = sum(tokens)
    raw = [(t / total) ** alpha for t in tokens]
    return [x / sum(raw) for x in raw]


def covering(tokens: list[int], own: list[float]) -> float:
    """The least budget in which every source passes once."""
    return max(t / w for t, w in zip(tokens, own))


def repetition(tokens: list[int], own: list[float], budget: float | None) -> float:
    """How often the most repeated source passes."""
    whole = covering(tokens, own) if budget is None else budget
    return max(w * whole / t for t, w in zip(tokens, own))


def bits(own: list[float]) -> float:
    return -sum(w * math.log2(w) for w in own if w > 0)


def temperature(tokens: list[int], budget: float | None, max_repeat: float | None, entropy: float | None) -> float:
    """The least exponent that meets the limit; ValueError where none does.

    Entropy falls as the exponent grows, so its search goes beyond 1 where it
    must. Repetition falls up to 1, where it is the budget over all tokens.
    """

    def low_enough(alpha: float) -> bool:
        own = weights(tokens, alpha)
        if entropy is not None:
            return bits(own) <= entropy + 1e-12
        return repetition(tokens, own, budget) <= max_repeat

    if low_enough(0.0):
        return 0.0
    low, high = 0.0, 1.0
    while not low_enough(high):
        if entropy is None and repetition(tokens, weights(tokens, high), budget) <= max_repeat * (1 + 1e-9):
            break
        if entropy is None or high >= LARGEST:
            raise ValueError(f"no exponent gives {'a repetition' if entropy is None else 'an entropy'} of {max_repeat if entropy is None else entropy} or less")
        low, high = high, 2 * high
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        low, high = (low, middle) if low_enough(middle) else (middle, high)
    return high


def planned(sources: list[Source], budget: float | None = None, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None) -> list[Source]:
    """Weights and quotas of sources."""
    if not sources:
        return []
    tokens = [s.tokens for s in sources]
    own = weights(tokens, temperature(tokens, budget, max_repeat, entropy))
    whole = covering(tokens, own) if budget is None else budget
    for s, w in zip(sources, own):
        s.weight, s.quota = w, math.floor(w * whole + 0.5)
        if budget is None:
            s.quota = max(s.quota, s.tokens)
    return sources


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float | None = None, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None, seed: int = SEED) -> DataFrame:
    """docs, each row as often as its source's epochs take it, with n_tokens, epoch, block and place in the block."""
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_row"), F.col(text_col).alias("mix_text"), (F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)) + 1).cast("long").alias("n_tokens"), name.alias("mix_source"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))).alias("mix_id"))
    totals = staged(rows.groupBy("mix_source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "mix-sources")
    sources = planned([Source(*r) for r in totals.orderBy("mix_source").collect()], budget, max_repeat, entropy)
    plan = spark.createDataFrame([(s.name, s.quota, s.quota // s.tokens, s.quota % s.tokens, max(1, -(-s.docs // BLOCK))) for s in sources], "plan_source string, quota long, passes long, rest long, blocks long")
    small = F.broadcast(plan) if len(sources) <= 10_000 else plan
    number = F.conv(F.substring(F.md5("mix_id"), 1, 8), 16, 10).cast("long")
    placed = rows.join(small, rows["mix_source"] == plan["plan_source"]).withColumn("block", F.pmod(number, F.col("blocks")))
    # whole epochs take every block; the last one takes blocks in order
    sums = placed.groupBy("mix_source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    epochs = F.sequence(F.lit(0).cast("long"), F.col("passes") - (F.col("rest") == 0).cast("long"))
    turns = sums.withColumn("epoch", F.explode(epochs)).withColumn("turn", _hash(F.lit(str(seed)), F.col("epoch").cast("string"), "mix_source", F.col("block").cast("string")))
    last = turns.where(F.col("epoch") == F.col("passes")).withColumn("range", F.substring("turn", 1, RANGE_DIGITS))
    ranges = last.groupBy("mix_source", "range").agg(F.sum("tokens").alias("own"))
    ranges = ranges.select("mix_source", "range", (F.sum("own").over(Window.partitionBy("mix_source").orderBy("range")) - F.col("own")).alias("ahead"))
    in_order = Window.partitionBy("mix_source", "range").orderBy("turn", "block")
    last = last.join(ranges, ["mix_source", "range"]).withColumn("left", F.col("rest") - F.col("ahead") - (F.sum("tokens").over(in_order) - F.col("tokens"))).where(F.col("left") > 0).select(*turns.columns, "left")
    whole = turns.where(F.col("epoch") < F.col("passes")).withColumn("left", F.col("tokens"))
    taken = whole.unionByName(last).groupBy("mix_source", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "left"))).alias("turns"))  # a block's epochs: bounded by the repetition
    read = placed.select("mix_row", "mix_text", "n_tokens", "mix_source", "mix_id", "block").join(taken, ["mix_source", "block"]).withColumn("turn", F.explode("turns"))
    read = read.withColumn("epoch", F.col("turn.epoch")).withColumn("left", F.col("turn.left")).withColumn("key", _hash(F.lit(str(seed)), F.col("epoch").cast("string"), "mix_id"))
    inside = Window.partitionBy("mix_source", "block", "epoch").orderBy("key", "mix_id", "mix_text")
    read = read.withColumn("place", F.row_number().over(inside).cast("long")).withColumn("before", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    return read.where(F.col("before") < F.col("left")).select("mix_row.*", *ADDED)
