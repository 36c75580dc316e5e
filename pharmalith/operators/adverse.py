"""Adverse-event reports: most reported reactions per substance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_reactions(requests: DataFrame, reports: DataFrame, k: int = 5, substance: str = "substance") -> DataFrame:
    """The ``k`` most reported reaction terms for each requested substance.

    ``reports`` holds ``substances`` and ``reactions`` as arrays of one report. The
    request is upper-cased and must equal a substance of the report in upper case; a
    report counts once per reaction term. Equal counts are ordered by term.
    """
    asked = requests.withColumn("_substance", F.upper(substance)).filter("_substance is not null")
    wanted = asked.select("_substance").distinct()
    # Pairs are unnested inside the report row and counted before anything is joined, so
    # what is shuffled is one row per substance, term and task.
    counts = (
        reports.select(
            F.explode(F.array_distinct(F.transform("substances", F.upper))).alias("_substance"),
            F.array_distinct("reactions").alias("reactions"),
        )
        .select("_substance", F.explode("reactions").alias("term"))
        .filter("term is not null and _substance is not null")
        .groupBy("_substance", "term")
        .agg(F.count(F.lit(1)).alias("count"))
        .join(wanted, "_substance", "left_semi")
    )
    most = Window.partitionBy("_substance").orderBy(F.desc("count"), "term")
    top = counts.withColumn("rank", F.row_number().over(most).cast("bigint")).filter(F.col("rank") <= k)
    return asked.join(top, "_substance").select(*requests.columns, "rank", "term", "count")
