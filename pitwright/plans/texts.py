"""Texts of filings: frequent words, and how far a section's similarity to the one before is from what is usual."""

from __future__ import annotations

import heapq
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwright.operators import xsec
from pitwright.operators.tswin import expanding_median
from pitwright.plans.axes import cleaned, standardised, words_of


def top_tokens(texts: DataFrame, keys: list[str], text: str, n: int = 400) -> DataFrame:
    """keys, token, count, place: the n most frequent words (letters and digits, two at least) of each text; ties in order of the word. keys
    tell texts apart. Texts are dealt to tasks by them, then a text's words are counted where it lies: words are never shuffled, and a task
    holds those of few texts at a time."""
    schema = T.StructType([*texts.select(*keys).schema.fields, T.StructField("token", T.StringType()), T.StructField("count", T.LongType()), T.StructField("place", T.IntegerType())])

    def counted(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # a bounded number of rows comes of each
                part = batch.slice(start, 64)
                best = [heapq.nsmallest(n, Counter(words_of(t.as_py())).items(), key=lambda e: (-e[1], e[0])) for t in part["__text"]]
                of = pa.array([i for i, b in enumerate(best) for _ in b], pa.int64())
                found = pa.array([w for b in best for w, _ in b], pa.string()), pa.array([k for b in best for _, k in b], pa.int64()), pa.array([p for b in best for p in range(1, len(b) + 1)], pa.int32())
                yield pa.RecordBatch.from_arrays([*(part[k].take(of) for k in keys), *found], names=schema.names)

    return texts.select(*keys, cleaned(text).alias("__text")).repartition(*keys).mapInArrow(counted, schema)


def normalised(df: DataFrame, sim: str, section: str, order: list[str], least: int = 30) -> DataFrame:
    """df with norm: sim less the median of the section's earlier rows, which takes away what all filings of a time share; where these are
    fewer than `least`, less the median of all rows so far. No row sees one after it."""
    a = expanding_median(df, sim, section, order, "__usual", least)
    a = expanding_median(a, sim, None, [*order, section], "__all", 1, lagged=False)
    return a.withColumn("norm", F.col(sim) - F.coalesce("__usual", "__all")).drop("__usual", "__all")


def by_filing(df: DataFrame, corp: str, day: str, risks: list[str], section: str = "section") -> DataFrame:
    """(corp, day, sim_risk, sim_all): means over the sections of a filing."""
    mean = lambda on: F.avg(F.when(on, F.col("norm")))
    return df.groupBy(corp, day).agg(mean(F.col(section).isin(risks)).alias("sim_risk"), mean(F.lit(True)).alias("sim_all"))


def text_axis(df: DataFrame) -> DataFrame:
    """df with sim_risk_pct (its rank in the cell, for a veto) and E_D, the z-score of the similarity of all sections."""
    a = standardised(df, {"sim_risk_pct": "sim_risk"}, xsec.rank_pct)
    return standardised(a, {"TP_D1": "sim_all"}).withColumn("E_D", F.col("TP_D1"))
