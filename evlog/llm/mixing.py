"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent in [0, 1] (1 keeps the
shares, 0 makes the sources equal) and normalised. The exponent is bisected to
meet a target entropy or a limit on how often a source may be repeated; then
each source's budget of tokens is filled from random permutations of its
documents, one permutation for each pass. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evlog.session import materialize

MAX_REPEATS = 2.0
SEED = 17
LEVELS, ROUNDS = 6, 5  # of bisection: 2**LEVELS - 1 exponents for each pass over the sources, so 30 halvings in 5 passes
DIGITS = 6  # of the exponent that are kept, so that the last bits of power functions don't matter
WEIGHT_DIGITS = 12  # of the weight shown, for the same reason
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 1 << 16  # wanted rows of the largest block


def exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent that ``shares(share)``, which add up to 1, need.

    With a target entropy (nats) it's the exponent whose weights have it (the
    nearest end, if none has). A limit on repeats asks for the smallest exponent
    at which no source is passed more than ``max_repeats`` times when the budget
    is the least that reads every source once. With both, the larger one holds.
    """
    def bisect(holds: Column) -> float:
        """The smallest t at which ``holds`` (of columns t, s, e, top, low), true from there on, is true; or 1."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            steps = [low + (high - low) * i / 2 ** LEVELS for i in range(1, 2 ** LEVELS)]
            at = F.explode(F.array(*map(F.lit, steps))).alias("t")
            power = F.pow("share", "t")
            sums = (shares.filter("share > 0").select("share", at)
                    .groupBy("t").agg(F.sum(power).alias("s"), F.sum(power * F.ln("share")).alias("e"),
                                      F.max("share").alias("top"), F.min("share").alias("low")))
            found = sums.filter(holds).agg(F.min("t")).first()[0]  # one number
            if found is None:
                low = steps[-1]
            else:
                low, high = found - (high - low) / 2 ** LEVELS, found
        return high

    chosen = 0.0
    if target_entropy is not None:
        chosen = max(chosen, bisect(F.ln("s") - F.col("t") * F.col("e") / F.col("s") <= target_entropy))
    if max_repeats is not None:
        chosen = max(chosen, bisect(F.pow(F.col("top") / F.col("low"), 1 - F.col("t")) <= max_repeats))
    return min(1.0, math.ceil(chosen * 10 ** DIGITS) / 10 ** DIGITS)  # up, so that a limit holds


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
                target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None,
                seed: int = SEED) -> DataFrame:
    """``(source, doc_id, epoch, block, position, n_tokens, weight)``, a row for each time a document is read.

    Tokens are the words of a text. A source with weight w gets round(w x
    budget) tokens; without ``budget`` it's the least at which each source is
    read at least once. Epoch 0, 1, ... of a source is a permutation of its
    documents: blocks in order, and in a block by a keyed hash of epoch and
    doc_id; position is the number of the epoch's tokens before the document. The last
    epoch stops before the document that would pass the source's budget.

    A null source is a source of its own. Null and wordless texts have no tokens:
    they're read in each epoch that reaches their position. A source without any token has weight 0 and
    is read once. Repeated rows are documents of their own, and ones that share
    hash and tokens get the same position. No rows in, no rows out.
    """
    counted = materialize(docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"),
                                      F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens")))
    totals = materialize(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    all_tokens, most_rows = totals.agg(F.sum("tokens"), F.max("rows")).first()
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(all_tokens or 1)))
    t = exponent(shares, target_entropy, max_repeats)
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(t))).otherwise(0.0)
    scale = shares.agg(F.sum(power), F.max(F.when(F.col("share") > 0, F.col("share") / power))).first()
    norm, once = (float(x or 1) for x in scale)
    total = float(all_tokens or 0) * once * norm if budget is None else float(budget)
    plan = shares.select("source", "tokens", (power / norm).alias("weight"), F.round(F.lit(total) * (power / norm)).cast("bigint").alias("quota"))
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1))

    digits = max(2, math.ceil(math.log((most_rows or 1) / BLOCK_ROWS, 16))) if most_rows else 2
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = (counted.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
             .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes"))))
             # The pass after the last full one is there only if tokens are left for it.
             .filter("epoch < passes OR quota > passes * tokens")
             .withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), name).cast("binary")))
             .withColumn("block", F.substring("draw", 1, digits)))
    key = ["source", "epoch", "block"]
    sums = drawn.groupBy(*key).agg(F.sum("n_tokens").alias("in_block"))
    ahead = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # 16**digits rows at most
    starts = sums.select(*(F.col(c).alias(f"{c}_") for c in key), F.coalesce(F.sum("in_block").over(ahead), F.lit(0)).alias("before"))
    inside = (Window.partitionBy("source", "epoch", "block").orderBy("draw", "doc_id", "n_tokens")
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (drawn.withColumn("upto", F.sum("n_tokens").over(inside))
              .join(starts, F.col("source").eqNullSafe(F.col("source_")) & (F.col("epoch") == F.col("epoch_")) & (F.col("block") == F.col("block_"))))
    position = F.col("before") + F.col("upto") - F.col("n_tokens")
    return (placed.filter((F.col("epoch") < F.col("passes")) | (F.col("epoch") * F.col("tokens") + F.col("before") + F.col("upto") <= F.col("quota")))
            .select("source", "doc_id", "epoch", "block", position.alias("position"), "n_tokens", F.round("weight", WEIGHT_DIGITS).alias("weight")))
