"""How good a ranking is: recall at 5, gain at 10, and how queries without an answer fare, also over several floors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sweep(results: DataFrame, labels: DataFrame, floors: list[float], penalties: list[float], deep: int = 10, shallow: int = 5) -> DataFrame:
    """For every floor and penalty (``floor``, ``penalty``): how many results are ``shown``, and how many of the first ``shallow`` of a query
    are ``found`` to be right (``labels``: ``query``, ``item``). ``results``: ``query``, ``item``, ``score``, ``n_chunks``. A penalty reorders
    by the logarithm of an item's chunks; a floor is for the score itself and cuts a ranking from below, so each penalty
    ranks once for all floors, and counts of scores serve them all."""
    spark = results.sparkSession
    of = lambda name, values: F.broadcast(spark.createDataFrame([(float(v),) for v in values], f"{name} double"))
    w = W.partitionBy("query", "penalty").orderBy(F.round(F.col("score") - F.col("penalty") * F.log("n_chunks"), 9).desc(), "item")
    ranked = results.crossJoin(of("penalty", penalties)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= deep)
    graded = ranked.join(labels.select("query", "item", F.lit(1).alias("right")), ["query", "item"], "left").crossJoin(of("floor", floors)).where("score >= floor")
    sums = graded.groupBy("penalty", "floor").agg(F.count(F.lit(1)).alias("shown"), F.sum(F.when(F.col("right").isNotNull() & (F.col("rank") <= shallow), 1).otherwise(0)).alias("found"))
    every = of("penalty", penalties).crossJoin(of("floor", floors)).join(sums, ["penalty", "floor"], "left")
    return every.select("penalty", "floor", F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("found", F.lit(0)).cast("bigint").alias("found"))


def evaluate(results: DataFrame, queries: DataFrame, labels: DataFrame, floors: list[float], deep: int = 10, shallow: int = 5) -> DataFrame:
    """A row for each floor: ``recall``, ``ndcg`` (both averages over answered queries), ``emptied`` (answered ones left without
    results), ``no_answer`` (part of the others that are empty, as they should be) and ``leaks`` (off-corpus ones that are not).

    ``results``: ``query``, ``item``, ``score``; ``queries``: ``query``, ``kind`` (answered, unanswered, off_corpus); ``labels``: ``query``, ``item``,
    ``grade``. Ranks are those of all results, by score, then item: a floor cuts them off from below, so one ranking serves
    all floors, and only the best ``deep`` of a query are kept per floor."""
    spark = results.sparkSession
    w = W.partitionBy("query").orderBy(F.desc("score"), "item")
    top = results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= deep)
    cuts = spark.createDataFrame([(float(f),) for f in floors], "floor double")
    kept = top.join(F.broadcast(cuts), F.col("score") >= F.col("floor"))
    graded = kept.join(labels, ["query", "item"], "left")
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    per = graded.groupBy("query", "floor").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("grade").isNotNull() & (F.col("rank") <= shallow), 1).otherwise(0)).alias("hits"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg")
    )
    best = labels.withColumn("k", F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"), "item")))
    ideal = best.groupBy("query").agg(
        F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("k") <= deep, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("k") + 1)).otherwise(0.0)).alias("idcg")
    )
    every = queries.join(F.broadcast(cuts)).join(per, ["query", "floor"], "left").join(ideal, "query", "left").fillna(0, ["n", "hits"]).fillna(0.0, ["dcg"])
    answered = F.col("kind") == "answered"
    recall = F.when(answered, F.col("hits") / F.least(F.col("relevant"), F.lit(shallow)))
    ndcg = F.when(answered, F.col("dcg") / F.col("idcg"))
    return every.groupBy("floor").agg(
        F.avg(recall).alias("recall"),
        F.avg(ndcg).alias("ndcg"),
        F.sum(F.when(answered & (F.col("n") == 0), 1).otherwise(0)).cast("bigint").alias("emptied"),
        F.avg(F.when(~answered, (F.col("n") == 0).cast("double"))).alias("no_answer"),
        F.sum(F.when((F.col("kind") == "off_corpus") & (F.col("n") > 0), 1).otherwise(0)).cast("bigint").alias("leaks"),
    )
