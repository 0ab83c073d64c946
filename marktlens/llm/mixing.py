"""Mixing sources to target weights, with DataFrame functions alone.

Sources weigh by their share of tokens raised to an exponent (one over the temperature). The exponent is bisected until
the weights have the wanted entropy, or until no source repeats more often than allowed; of both, the limit of repeats wins. The weights are then realised as
whole and part permutations of each source: epoch after epoch in an order drawn by hash, as far as the source's budget
goes, cut into blocks that all hold the sources in the target proportions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktlens.llm.common import SALTS, checkpoint, salted

#: Tokens are runs of characters other than ASCII white space.
TOKEN = r"[^\x09-\x0D\x20]+"
#: Pieces of a source's permutation that are summed up apart; a running sum spans the pieces, others the rows in each.
PIECES = 1024
#: Epochs of a document that one task emits at once; more are dealt out.
SPAN = 1024
#: Halvings of the exponent's interval in each job, and jobs.
LEVELS, PASSES = 5, 10
HIGHEST = 8.0


def _entropy(a: float) -> Column:
    """Entropy in nats of the weights p^a / sum(p^a)."""
    z, l = F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p"))
    return F.log(z) - F.lit(a) * l / z


def _repeats(a: float) -> Column:
    """Most epochs of a source when the least repeated one is taken whole once."""
    return F.pow(F.max("p") / F.min("p"), F.lit(abs(1.0 - a)))


def exponent(shares: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent at which weights p^a reach the target: the largest in [0, 8] with at least `target_entropy` times the
    entropy of equal weights, or the smallest in [0, 1] with at most `max_repeats` epochs of a source for each of
    another, or the larger of both. Each job evaluates all midpoints that the next five halvings can meet: one row, whatever the sources."""
    if target_entropy is None and max_repeats is None:
        raise ValueError("give target_entropy, max_repeats or both")
    if target_entropy is not None and max_repeats is not None:
        return max(exponent(shares, target_entropy=target_entropy), exponent(shares, max_repeats=max_repeats))
    lo, hi = 0.0, HIGHEST if max_repeats is None else 1.0

    def midpoints(lo: float, hi: float, levels: int) -> list[float]:
        mid = (lo + hi) / 2
        return [mid] if levels == 1 else [mid, *midpoints(lo, mid, levels - 1), *midpoints(mid, hi, levels - 1)]

    for _ in range(PASSES):
        grid = list(dict.fromkeys(midpoints(lo, hi, LEVELS)))
        value = _entropy if max_repeats is None else _repeats
        row = shares.agg(F.count("*").alias("n"), *(value(a).alias(f"v{i}") for i, a in enumerate(grid))).first()
        if not row.n:
            return 1.0
        at = {a: row[f"v{i}"] for i, a in enumerate(grid)}
        for _ in range(LEVELS):
            mid = (lo + hi) / 2
            if max_repeats is None:
                lo, hi = (mid, hi) if at[mid] >= target_entropy * math.log(row.n) else (lo, mid)
            else:
                lo, hi = (lo, mid) if at[mid] <= max_repeats else (mid, hi)
    return lo if max_repeats is None else hi


def weights(rows: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """For each source `_s` of rows (_s, tokens): its tokens, weight, quota (tokens to take), epochs (whole ones) and part
    (tokens of the last, partial epoch). Without a budget, the smallest that takes every source whole at least once."""
    sums = checkpoint(rows.groupBy("_s").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.withColumn("p", F.col("tokens") / F.lit(float(total or 1)))
    a = exponent(shares, target_entropy, max_repeats)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    shares = shares.withColumn("weight", F.pow("p", F.lit(a)) / F.lit(z))
    if budget is None:
        budget = shares.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    quota = F.round(F.col("weight") * F.lit(float(budget))).cast("long")
    shares = shares.withColumn("quota", quota)
    return shares.select("_s", F.col("tokens").alias("source_tokens"), "weight", "quota", F.expr("quota div tokens").alias("epochs"), F.expr("quota % tokens").alias("part"))


def draw(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, blocks: int = 64, seed: int = 1) -> DataFrame:
    """One row for each time that a document is drawn: doc_id, row_key, source, tokens, epoch, block, start (tokens of its
    source before it), order (key of its place in the block).

    A null source is a source of its own; documents without tokens are drawn once, at their place in the first epoch.
    Repeated rows are drawn each for itself; ties go by row key. Without a limit of repeats, a source with the share p of the tokens comes up to
    (largest share / p) ^ (1 - exponent) times as often as the largest, so a very small one makes many rows; max_repeats bounds that. The last epoch of a source ends before the first
    document that would pass its quota. An empty table gives an empty result. Only doc_id, source and text are read."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long")
    name = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "source", name.alias("_s"), tokens.alias("tokens"))
    rows = checkpoint(rows)
    # every source's weights are there once for each salt, so that the rows of a hot source are dealt to many tasks
    made = weights(rows, target_entropy, max_repeats, budget).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = salted(rows, "doc_id", "row_key").join(made, ["_s", "_salt"], "left").drop("_salt")
    last = F.when(F.col("tokens") == 0, 0).otherwise(F.coalesce(F.expr("epochs - if(part = 0, 1, 0)"), F.lit(0)))
    rows = rows.withColumn("_last", last.cast("long"))
    most = made.agg(F.max("epochs")).first()[0] or 0
    if most > SPAN:  # a small source may repeat very often: spans of epochs are dealt to many tasks
        rows = rows.withColumn("_span", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_last div {SPAN}"))))
        rows = rows.repartition("doc_id", "row_key", "_span").withColumn("epoch", F.explode(F.sequence(F.col("_span") * SPAN, F.least("_last", F.col("_span") * SPAN + SPAN - 1)))).drop("_span")
    else:
        rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    rows = rows.drop("_last")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("epoch").cast("string")))
    rows = rows.withColumn("order", key).withColumn("piece", F.conv(F.substring("order", 1, 4), 16, 10).cast("int") % PIECES)
    place = Window.partitionBy("_s", "epoch", "piece").orderBy("order", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumn("_upto", F.sum("tokens").over(place))
    sums = rows.groupBy("_s", "epoch", "piece").agg(F.sum("tokens").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_s", "epoch").orderBy("piece")) - F.col("_sum")).drop("_sum")
    found = within.join(before, ["_s", "epoch", "piece"]).withColumn("_end", F.col("_before") + F.col("_upto"))
    found = found.filter("tokens = 0 or epoch < epochs or _end <= part").withColumn("start", F.expr("epoch * coalesce(source_tokens, 0) + _end - tokens"))
    block = F.least(F.coalesce(F.expr(f"start * {int(blocks)} div nullif(quota, 0)"), F.lit(0)), F.lit(int(blocks) - 1)).cast("int")
    return found.select("doc_id", "row_key", "source", "tokens", F.col("epoch").cast("int").alias("epoch"), block.alias("block"), "start", "order")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as it is drawn, with the columns of `docs` alone, in the order of the blocks and of the
    places within them: partition after partition, and so file after file when they are written.

    A null source is one of its own; rows without tokens come once; ids and texts may be null or repeat: of rows that are
    equal in id, text and source each gets draws of its own. An empty table gives an empty result. Columns of docs may have any
    name but those that begin with `_mix`."""

    def keyed(rows: DataFrame, key) -> DataFrame:
        name = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))
        return rows.withColumn("_mix_d", F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).withColumn("_mix_k", key).withColumn("_mix_s", name)

    keys = ["_mix_d", "_mix_k", "_mix_s"]
    # the n-th of equal rows takes the n-th draw of each epoch
    drawn = keyed(draw(docs, **options), F.col("row_key")).withColumn("_mix_n", F.row_number().over(Window.partitionBy(*keys, "epoch").orderBy("start")))
    drawn = drawn.select(*keys, "_mix_n", F.col("block").alias("_mix_b"), F.col("order").alias("_mix_o"))
    # rows and draws meet in one shuffle by their key, and within it by number: a join would pair all of many equal rows with each other
    rows = keyed(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_mix_r")), F.xxhash64("text")).select(*keys, "_mix_r")
    both = rows.unionByName(drawn, allowMissingColumns=True)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_mix_n").isNotNull()))
    both = both.withColumn("_mix_draw", F.col("_mix_n").isNotNull()).withColumn("_mix_n", F.coalesce("_mix_n", number))
    own = Window.partitionBy(*keys, "_mix_n").orderBy("_mix_draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_mix_r", F.first("_mix_r", ignorenulls=True).over(own)).filter("_mix_draw").select("_mix_b", "_mix_o", "_mix_k", "_mix_r.*")
    return found.repartitionByRange("_mix_b", "_mix_o", "_mix_k").sortWithinPartitions("_mix_b", "_mix_o", "_mix_k").select(*docs.columns)
