"""Mixing sources to target weights: temperature, then budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Blocks that each source is dealt into; a source's order is settled on these alone.
BLOCKS = 4_096
#: Exponents tried at once in a round of the search, and rounds: the interval ends below 1e-10.
TRIED, ROUNDS = 32, 7
#: Blocks whose plan is broadcast at most, some 40 bytes each; more of them are joined.
BROADCAST_ROWS = 500_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class Shares:
    """What the search for an exponent needs of the sources' token counts: sums over all of them, whatever their number."""

    def __init__(self, sources: DataFrame):
        self.sources = sources.where("tokens > 0")
        self.used, self.total, self.least, self.most = self.sources.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0)), F.min("tokens"), F.max("tokens")).first()

    def sums(self, exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent a the sums of x**a and of x**a * ln(x), x being a source's tokens over the largest's."""
        x = F.col("tokens") / F.lit(float(self.most))
        terms = [t for a in exponents for t in (F.sum(F.pow(x, F.lit(a))), F.sum(F.pow(x, F.lit(a)) * F.log(x)))]
        row = self.sources.agg(*terms).first()
        return list(zip(row[::2], row[1::2], strict=True))

    def entropy(self, a: float, sums: tuple[float, float]) -> float:
        z, l = sums
        return math.log(z) - a * l / z

    def repetition(self, a: float, sums: tuple[float, float], budget: float) -> float:
        """How often the most repeated source is seen when budget tokens are drawn; for exponents up to 1 the smallest one."""
        return budget * (self.least / self.most) ** a / sums[0] / self.least

    def exponent(self, budget: float, *, target_entropy: float | None = None, most_repeats: float | None = None) -> float:
        """The exponent between 0 (even weights) and 1 (the sources' own shares).

        With target_entropy the largest that reaches this share of the greatest entropy, with most_repeats the smallest
        under which no source is repeated more often; with both, the larger of the two, as the limit binds. Entropy and
        repetition fall as the exponent rises, so the interval in which each crosses its mark is narrowed, TRIED
        exponents a round. Unreachable: the nearer end. Rounded up to 1e-9, so that it doesn't hang on the order of sums.
        """
        out = 0.0
        if not self.used:
            return out
        if target_entropy is not None and self.used > 1:
            wanted = target_entropy * math.log(self.used)
            out = self._last(lambda a, s: self.entropy(a, s) >= wanted)
        if most_repeats is not None:
            above = self._last(lambda a, s: self.repetition(a, s, budget) > most_repeats)
            out = max(out, min(1.0, math.ceil(above * 1e9 + 0.5) / 1e9) if above >= 0 else 0.0)
        return max(0.0, min(1.0, round(out, 9)))

    def _last(self, holds) -> float:
        """The largest exponent up to which holds is true, or -1."""
        low, high = 0.0, 1.0
        for turn in range(ROUNDS):
            tried = [low + (high - low) * i / TRIED for i in range(TRIED + 1)]
            true = [holds(a, s) for a, s in zip(tried, self.sums(tried), strict=True)]
            if not true[0]:
                return -1.0 if turn == 0 else low
            last = max(i for i, t in enumerate(true) if t)
            if last == TRIED:
                return high
            low, high = tried[last], tried[last + 1]
        return low


def _dealt(docs: DataFrame, seed: int, blocks: int) -> list[Column]:
    """_source and _block of each row."""
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [source.alias("_source"), F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text), F.lit(blocks)).cast("int").alias("_block")]


def _plan(sized: DataFrame, budget_share: float, target_entropy: float | None, most_repeats: float | None, seed: int) -> DataFrame:
    """_source, _block, weight, copies, place: how often each block is drawn, and its place in its source's permutation."""
    # At most `blocks` rows a source, after partial sums on the map side.
    dealt = cut(sized.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("_tokens")))
    sources = cut(dealt.groupBy("_source").agg(F.sum("_tokens").alias("tokens")))
    shares = Shares(sources)
    budget = budget_share * shares.total
    a = shares.exponent(budget, target_entropy=target_entropy, most_repeats=most_repeats)
    z = shares.sums([a])[0][0] if shares.used else 1.0
    # Rounded, so that the order in which the sum was made doesn't show.
    weight = F.when(F.col("tokens") > 0, F.round(F.pow(F.col("tokens") / F.lit(float(shares.most or 1)), F.lit(a)) / F.lit(z), 12)).otherwise(0.0)
    wanted = F.col("weight") * F.lit(float(budget))
    passes = F.when(F.col("tokens") > 0, F.floor(wanted / F.col("tokens"))).otherwise(0).cast("long")
    plan = sources.withColumn("weight", weight).select("_source", "weight", passes.alias("_passes"), (wanted - passes * F.col("tokens")).alias("_left"))
    order = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed + 1), "_block"), "_block")
    taken = dealt.join(plan, "_source").withColumn("place", F.row_number().over(order))
    taken = taken.withColumn("_before", F.coalesce(F.sum("_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    drawn = F.when(F.col("weight") > 0, F.col("_passes") + (F.col("_before") < F.col("_left")).cast("int")).otherwise(0)
    taken = cut(taken.select("_source", "_block", "weight", drawn.cast("long").alias("copies"), "place"))
    return F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken


def mix_sources(docs: DataFrame, *, budget_share: float = 1.0, target_entropy: float | None = 0.97, most_repeats: float | None = 4.0, seed: int = 11, blocks: int = BLOCKS) -> DataFrame:
    """How often each document is drawn: doc_id, source, n_tokens, weight (its source's), copies; one row for each row of docs.

    The budget is budget_share of all tokens (words). A source with weight w gets w * budget tokens: as many whole
    passes as fit, then blocks in a permuted order for as long as tokens are left; the block in which they run out is
    taken whole, so a source exceeds its budget by one of its blocks at most. Documents go to blocks by a hash of id and
    text. There may be any number of sources. A null source is a source of its own, a null or empty text has 0 tokens
    and its block's fate; sources without tokens get weight 0 and no copies. Repeated rows are drawn alike; other
    columns are left out, whatever their names. An empty input gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *_dealt(docs, seed, blocks), n_words(text).alias("n_tokens")))
    taken = _plan(sized, budget_share, target_entropy, most_repeats, seed)
    return sized.join(taken, ["_source", "_block"]).select("doc_id", "source", "n_tokens", "weight", "copies")


def mixture(docs: DataFrame, *, budget_share: float = 1.0, target_entropy: float | None = 0.97, most_repeats: float | None = 4.0, seed: int = 11, blocks: int = BLOCKS) -> DataFrame:
    """The mixture itself: a row for each time a document is drawn by mix_sources.

    doc_id, source, text, n_tokens, weight, draw (1 for the first pass over its source, and so on) and place (that of
    its block in the source's permutation): by draw, then place, a source is read in the order that its budget was
    spent. Documents with no copies are out. Nulls, empty texts and clashing columns are as in mix_sources.
    """
    text = F.col("text").cast("string").alias("text")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text, *_dealt(docs, seed, blocks), n_words(F.coalesce(text, F.lit(""))).alias("n_tokens"))
    taken = _plan(whole.select("_source", "_block", "n_tokens"), budget_share, target_entropy, most_repeats, seed)
    drawn = whole.join(taken.where("copies > 0"), ["_source", "_block"])
    return drawn.select("doc_id", "source", "text", "n_tokens", "weight", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("draw"), "place")
