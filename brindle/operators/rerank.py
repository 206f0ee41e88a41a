"""Reranking of fused candidates, which degrades to their own order."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Reranker(Protocol):
    enabled: bool

    def score(self, query: str, texts: list[str]) -> list[float]: ...


class OverlapReranker:
    """The share of the query's words that a text contains."""

    enabled = True

    def score(self, query: str, texts: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [sum(w in t.lower() for w in words) / len(words) if words else 0.0 for t in texts]


def rerank(candidates: DataFrame, reranker: Reranker, top_k: int) -> DataFrame:
    """The ``top_k`` best of every query by the reranker's score, with rerank_score, reranked and fused_rank anew.

    ``candidates`` (query_id, query, content, fused_rank, ...) are few per query. A failure of the scorer is a value of its
    batch, not of the job: such a query keeps its order, has no rerank score and carries the warning.
    """

    @F.pandas_udf("score double, warning string")
    def run(query: pd.Series, content: pd.Series) -> pd.DataFrame:
        scores, warnings = pd.Series([None] * len(query), dtype="float64"), pd.Series([None] * len(query), dtype=object)
        for own, at in query.groupby(query).groups.items():
            try:
                scores.loc[at] = reranker.score(own, content.loc[at].tolist())
            except Exception as e:  # whatever a remote scorer raises
                warnings.loc[at] = f"rerank unavailable ({type(e).__name__}): results keep retrieval order"
        return pd.DataFrame({"score": scores, "warning": warnings})

    per_query = Window.partitionBy("query_id")
    scored = candidates.withColumn("_r", run("query", "content"))
    scored = scored.withColumn("warning", F.max("_r.warning").over(per_query)).withColumn("reranked", F.col("warning").isNull())
    scored = scored.withColumn("rerank_score", F.when(F.col("reranked"), F.col("_r.score"))).drop("_r")
    order = per_query.orderBy(F.col("rerank_score").desc_nulls_last(), "fused_rank")
    return scored.withColumn("fused_rank", F.row_number().over(order)).filter(F.col("fused_rank") <= top_k)
