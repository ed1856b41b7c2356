"""Filter interaction audit: what each filter removes at each place of every order, from one cube over the failure flags."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters of the query, in the order of their letters.
FLAGS = ("A", "B", "C", "D", "E")
#: More filters than this have over 40,320 orders.
MOST_FLAGS = 8
#: Counts that are carried along beside the number of documents.
MEASURES = ("n", "good", "toxic")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, print and the flags A to D of each row of docs, by built-in expressions over its whole text.

    A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * [A-Z] > 3 * code points; D: any of #$%&*|.
    A null text is empty and fails A alone; print is the text's SHA-256, part its lang, empty where null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("text")).withColumn("words", _words(F.col("text")))
    counted = rows.withColumns({"n_words": F.size("words"), "distinct": F.size(F.array_distinct("words")), "chars": F.length("text"), "lower": F.length(F.regexp_replace("text", "[A-Z]+", ""))})
    return counted.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("print"),
        (F.col("n_words") < 200).alias("A"),
        (100 * F.col("distinct").cast("long") < 50 * F.col("n_words").cast("long")).alias("B"),
        (100 * (F.col("chars") - F.col("lower")).cast("long") > 3 * F.col("chars").cast("long")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, n, good, toxic: documents by part and what they fail, at most 32 rows a part.

    E: the text is also that of a row with a smaller doc_id, anywhere in the table; so of each text the rows with its
    smallest id pass, repeated ones too, and rows without an id pass, as nothing is smaller than none. Rows are counted a
    text, part and id before they meet by id and by text, so neither copies of one text nor rows without an id gather in
    one task: of a text there come together the smallest id of each part, with its counts.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("id is not null")
    labels = labels.groupBy("id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("is_toxic"))
    flags = FLAGS[:4]
    own = failures(docs).groupBy("doc_id", "print", "part", *flags).agg(F.count("*").alias("n"))
    # A row without an id meets no label; its text's hash spreads such rows over the tasks.
    met = own.withColumn("id", F.coalesce("doc_id", F.xxhash64("print"))).join(labels, "id", "left")
    mark = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, F.lit(0))).otherwise(0) * F.col("n")
    met = met.select("doc_id", "print", "part", *flags, "n", mark("is_good").alias("good"), mark("is_toxic").alias("toxic"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *MEASURES)))
    texts = met.groupBy("print", "part", *flags).agg(*[F.sum(m).alias(m) for m in MEASURES], F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first.alias("first"))
    # One row a part here, however many copies.
    texts = texts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("print")))
    passes = lambda m: F.when(F.col("first.doc_id") == F.col("least"), F.col(f"first.{m}")).otherwise(0) + (F.col("nameless") if m == "n" else 0)
    kept = F.struct(F.lit(False).alias("E"), *[passes(m).alias(m) for m in MEASURES])
    lost = F.struct(F.lit(True).alias("E"), *[(F.col(m) - passes(m)).alias(m) for m in MEASURES])
    both = texts.select("part", *flags, F.explode(F.array(kept, lost)).alias("x")).select("part", *flags, "x.*").where("n > 0")
    return both.groupBy("part", *FLAGS).agg(*[F.sum(m).alias(m) for m in MEASURES])


def survivors(counts: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """part, mask, n, good, toxic: what passes all filters of a set (bit i: flags[i]), for each set that leaves anything.

    One CUBE over the flags and part: a grouping set selects filters, its row with all of them false are the survivors.
    """
    cube = counts.cube(*flags, "part").agg(*[F.sum(m).alias(m) for m in MEASURES], F.grouping("part").alias("whole"), *[F.grouping(f).alias(f"_{i}") for i, f in enumerate(flags)])
    passed = ~F.coalesce(F.greatest(*[F.coalesce(f, F.lit(False)) for f in flags]), F.lit(False)) if len(flags) > 1 else ~F.coalesce(F.col(flags[0]), F.lit(False))
    mask = sum(((1 - F.col(f"_{i}").cast("int")) * (1 << i) for i in range(len(flags))), F.lit(0))
    return cube.where((F.col("whole") == 0) & passed).select("part", mask.cast("int").alias("mask"), *MEASURES)


def steps(flags: tuple[str, ...]) -> list[tuple[str, int, str, int, int]]:
    """filter_order, step, filter and the sets before and after it."""
    out = []
    for order in itertools.permutations(range(len(flags))):
        name, before = "".join(flags[i] for i in order), 0
        for step, i in enumerate(order, 1):
            out.append((name, step, flags[i], before, before | 1 << i))
            before |= 1 << i
    return out


def interactions(counts: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    counts has part, a boolean column a flag, and the counts n, good and toxic; flags and part are never null, names of
    flags are single letters. Each step joins the survivors of two sets, those before it and those after it. A filter
    that comes first removes all that fail it, one that comes last those that fail nothing else; shapley sums what it
    removes over all orders. Empty counts give no rows, as there is no part. Rows of one part and filter are as many as
    orders, so windows over them are small.
    """
    if not 1 <= len(flags) <= MOST_FLAGS:
        raise ValueError(f"from 1 to {MOST_FLAGS} filters")
    spark = counts.sparkSession
    # 32 rows a part for five filters; the cube is made once and read three times.
    alive = survivors(counts, flags)
    plan = spark.createDataFrame(steps(flags), "filter_order string, step int, filter string, before int, after int")
    # At most 8! * 8 rows, whatever the tables hold.
    parts = alive.where("mask = 0").select("part")
    grid = parts.select("part", F.explode(F.array(*[F.lit(1 << i) for i in range(len(flags))])).alias("bit"))
    bits = plan.withColumn("bit", F.col("after") - F.col("before"))
    grid = grid.join(F.broadcast(bits), "bit").select("part", "filter_order", "step", "filter", "before", "after")
    side = lambda key: alive.select("part", F.col("mask").alias(key), *[F.col(m).alias(f"{key}_{m}") for m in MEASURES])
    both = grid.join(side("before"), ["part", "before"], "left").join(side("after"), ["part", "after"], "left")
    count = lambda key, m: F.coalesce(F.col(f"{key}_{m}"), F.lit(0)).cast("long")
    lost = lambda m: count("before", m) - count("after", m)
    each = both.select("part", "filter_order", "step", "filter", count("after", "n").alias("kept"), lost("n").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    own = Window.partitionBy("part", "filter")
    fails = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(own)
    alone = F.max(F.when(F.col("step") == len(flags), F.col("removed"))).over(own)
    return each.select(
        "part", "filter_order", "step", "filter", "kept", "removed", (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(own).alias("shapley")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions of the five filters of ``failures`` and ``counted`` over docs, by lang.

    Null texts are empty, null langs the empty part. Rows without an id or label count as documents, as neither good nor
    toxic; an id with contradicting labels counts as 1. Repeated rows count each; other columns are ignored. No documents:
    no rows. Texts are read once and never shuffled, their hashes are.
    """
    return interactions(counted(docs, labels))
