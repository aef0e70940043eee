"""A mixture of sources by target shares of all tokens, with capped repeats, by subset-sum budget fitting.

Documents are counted by source and exact token length. A source's budget is filled by whole passes first; what is
left of it is fitted by a bounded knapsack over the lengths, a dynamic programme over the sums. It runs over the whole
budget, or first over a smaller part of it, with even shares of every length taken before: if it meets the budget
exactly then no other choice is nearer, else the part is widened, up to the whole budget. Which documents of a length
are taken is decided by a seeded hash, through counts by hash bucket, so that a length that holds most rows is never
sorted in one task.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbograph.llm.parse import spread
from arbograph.llm.tokenize import RANKS, token_counts
from arbograph.runtime import stored

BUCKETS = 4096
#: Sums of the first programme, in units of the lengths' greatest common divisor; it is widened until it fits.
FIRST = 1 << 16
#: Sums of the widest programme (a word of memory each); a budget beyond it that is not met exactly is reported as short.
MOST = 1 << 26


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum comes as near as it can to the budget, from below: exact.

    Sums are bits of an integer and counts are cut into parts of powers of two. Of each sum only the part that reached it
    first is kept, by which the choice is read back: a part was added to a sum that earlier parts had reached.
    """
    parts: list[tuple[int, int]] = []
    for i, (a, c) in enumerate(zip(lengths, counts, strict=True)):
        c = min(c, budget // a)
        k = 1
        while c > 0:
            parts.append((i, min(k, c)))
            c -= min(k, c)
            k *= 2
    mask = (1 << (budget + 1)) - 1
    sums, first = 1, np.full(budget + 1, -1, np.int32)
    for number, (i, k) in enumerate(parts):
        new = (sums << (lengths[i] * k)) & mask & ~sums
        if not new:
            continue
        raw = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
        at = np.flatnonzero(raw)
        hit = np.unpackbits(raw[at], bitorder="little").reshape(-1, 8)
        row, bit = np.nonzero(hit)
        first[at[row] * 8 + bit] = number
        sums |= new
        if sums >> budget & 1:
            break
    taken = [0] * len(lengths)
    at = sums.bit_length() - 1
    while at:
        i, k = parts[first[at]]
        taken[i] += k
        at -= lengths[i] * k
    return taken


def fit(lengths: list[int], counts: list[int], budget: int, first: int = FIRST, most: int = MOST) -> tuple[list[int], int]:
    """How many of each length to take so that their sum comes as near as it can to the budget, from below; and the tokens it is short of it.

    lengths ascend and differ; 0 <= taken <= counts. The programme runs over `first` sums, at least twice the longest
    length, and over four times as many each time that it is short, until it covers the whole budget or `most` sums. A
    result that is short of the budget only by what no sum of the lengths can be (the remainder by their greatest common
    divisor) is exact, and so is one over the whole budget.
    """
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts), budget - total
    unit = gcd(*lengths)
    rest, budget = budget % unit, budget // unit
    sizes = [a // unit for a in lengths]
    total //= unit
    span = max(first, 2 * sizes[-1])
    best: tuple[list[int], int] | None = None
    while True:
        # Even shares leave documents of every length open to the programme.
        part = max(0, budget - span)
        even = [c * part // total for c in counts]
        left = budget - sum(a * b for a, b in zip(sizes, even, strict=True))
        for i in range(len(sizes) - 1, -1, -1):  # what the rounding of the shares left, down to the span
            if left > 2 * span:
                more = min(counts[i] - even[i], (left - span) // sizes[i])
                even[i] += more
                left -= more * sizes[i]
        more = knapsack(sizes, [c - e for c, e in zip(counts, even, strict=True)], left)
        short = left - sum(a * b for a, b in zip(sizes, more, strict=True))
        if best is None or short < best[1]:
            best = [e + m for e, m in zip(even, more, strict=True)], short
        if best[1] == 0 or part == 0 or span >= most:
            return best[0], best[1] * unit + rest
        span = min(span * 4, max(most, 2 * sizes[-1]))


def _plan(total: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n_tokens")
        lengths, counts = frame["n_tokens"].tolist(), frame["n"].tolist()
        own = sum(a * b for a, b in zip(lengths, counts, strict=True))
        budget, most = int(round(float(frame["target_share"].iloc[0]) * total)), int(frame["max_repeats"].iloc[0])
        passes = min(most, budget // own)
        taken, short = fit(lengths, counts, budget - passes * own) if passes < most else ([0] * len(lengths), budget - passes * own)
        return pd.DataFrame({"source": frame["source"], "n_tokens": frame["n_tokens"], "passes": passes, "extra": taken, "budget": budget, "short": short})

    return run


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 1, total_tokens: int | None = None, path: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens, uses): how often each document is used, for documents that are.

    The size is total_tokens, by default all tokens of the sources in targets; each source's budget is its share of it.
    A source that can't fill its budget is used max_repeats times whole. Documents without tokens, of other sources or
    of a null source stay out. A null or negative share or max_repeats counts as 0. Repeated rows of a doc_id are documents each.
    """
    wanted = targets.filter("source IS NOT NULL").groupBy("source").agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"))
    # Spread before the join: asking a plan with a broadcast for its partitions would run it.
    known = spread(docs.filter("source IS NOT NULL").select("doc_id", "text", "source")).join(F.broadcast(wanted.select("source")), "source", "left_semi")  # a row per source of the control table
    counted = stored(token_counts(known, path, ("source",), spread_out=True).filter("n_tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "counted")
    by_length = counted.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    if total_tokens is None:
        total_tokens = counted.agg(F.sum("n_tokens")).first()[0] or 0
    # One row per source and length: as many as there are different lengths, whatever the number of documents.
    plan = stored(by_length.join(F.broadcast(wanted), "source").groupBy("source").applyInPandas(_plan(total_tokens), "source string, n_tokens long, passes long, extra long, budget long, short long"), "mix-plan").drop("budget", "short")
    key = ["source", "n_tokens"]
    bucket = F.pmod(F.col("h"), F.lit(BUCKETS)).cast("int")
    buckets = counted.withColumn("bucket", bucket).groupBy(*key, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(plan, key)
    # A bucket is taken whole, not at all, or (one of each length) in part: only that one is ranked.
    room = F.col("extra") - F.col("before")
    buckets = buckets.select(*key, "bucket", "passes", F.when(room >= F.col("n"), -1).otherwise(F.greatest(room, F.lit(0))).alias("room"))
    rows = counted.withColumn("bucket", bucket).join(buckets, [*key, "bucket"])
    whole = rows.filter("room <= 0").withColumn("uses", F.col("passes") + F.when(F.col("room") < 0, 1).otherwise(0))
    rank = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("h", "doc_id"))
    part = rows.filter("room > 0").withColumn("uses", F.col("passes") + F.when(rank <= F.col("room"), 1).otherwise(0))
    out = ["doc_id", "source", "n_tokens", "uses"]
    return whole.select(*out).unionByName(part.select(*out)).filter("uses > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_documents, max_uses) for every source of targets; shares are of the mixture's own size."""
    got = stored(mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("n_documents"), F.max("uses").alias("max_uses")), "mix-shares")
    total = got.agg(F.sum("tokens")).first()[0] or 0
    actual = F.col("n_tokens") / F.lit(total) if total else F.lit(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return targets.filter("source IS NOT NULL").select("source", "target_share").join(got, "source", "left").select("source", "target_share", zero("tokens").alias("n_tokens"), zero("n_documents").alias("n_documents"), zero("max_uses").alias("max_uses")).withColumn("actual_share", actual)

