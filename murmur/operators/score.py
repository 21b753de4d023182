"""Sentiment scoring: pluggable scorer, decision step, training, analysis batch (M1-M4).

The original shipped no model weights, so the default scorer is an MLlib
pipeline trained on labelled posts; any Python scorer can be plugged in
through an Arrow-batched ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import cut
from .tfidf import post_keywords

NUM_FEATURES = 1 << 18


def decide(p_neg: Column, p_pos: Column) -> Column:
    """M2: class 1 iff P(pos) > P(neg) (a tie is negative); score = the larger."""
    return F.struct(F.when(p_pos > p_neg, 1).otherwise(0).alias("sentiment"),
                    F.greatest(p_pos, p_neg).cast("float").alias("sentiment_score"))


def with_tokens(posts: DataFrame, text_col: str = "content") -> DataFrame:
    """The classifier's input: the library's tokens (Han runs as bigrams), none
    taken out as stop words."""
    return posts.withColumn("_tok", tokenize(F.col(text_col), []))


def build_pipeline(label_col: str = "label") -> Pipeline:
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=NUM_FEATURES)
    idf = IDF(inputCol="_tf", outputCol="_features", minDocFreq=2)
    lr = LogisticRegression(featuresCol="_features", labelCol=label_col, maxIter=30, regParam=0.01)
    return Pipeline(stages=[tf, idf, lr])


def train(labelled: DataFrame, text_col: str = "content", label_col: str = "label") -> PipelineModel:
    """M3: fit the default classifier (distributed MLlib training)."""
    data = labelled.select(text_col, F.col(label_col).cast("double").alias(label_col))
    return build_pipeline(label_col).fit(with_tokens(data, text_col))


SCORE_BINS = 1024


def binary_metrics(pred: DataFrame, label_col: str = "label", score_col: str = "score", class_col: str = "prediction") -> DataFrame:
    """M3: exact area under ROC, accuracy and size of predictions (label 0/1,
    score in [0, 1], predicted class), one row; auc is null without both labels.

    The area is the share of (positive, negative) pairs in which the positive
    has the larger score, equal ones counting half: a running count of
    negatives over the distinct scores, taken inside score bins of equal width
    that each start from the count of the bins below (SCORE_BINS rows)."""
    own = cut(pred.select(F.col(label_col).cast("int").alias("y"), F.col(score_col).cast("double").alias("s"),
                          (F.col(class_col).cast("int") == F.col(label_col).cast("int")).cast("int").alias("hit")))
    by = (own.groupBy("s").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
          .withColumn("bin", F.least(F.floor(F.col("s") * SCORE_BINS), F.lit(SCORE_BINS - 1)).cast("int")))
    under = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = by.groupBy("bin").agg(F.sum("neg").alias("n")).select("bin", F.coalesce(F.sum("n").over(under), F.lit(0)).alias("_below"))
    inside = Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    won = (by.withColumn("_in", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(bins, "bin")
           .agg(F.sum(F.col("pos") * (F.col("_below") + F.col("_in") + F.col("neg") / 2)).alias("won"),
                F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    size = own.agg(F.avg("hit").alias("accuracy"), F.count(F.lit(1)).alias("n_test"))
    return (won.crossJoin(size)     # one row each
               .select((F.col("won") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).alias("auc"), "accuracy", "n_test"))


def evaluate(model: PipelineModel, test: DataFrame, text_col: str = "content", label_col: str = "label") -> DataFrame:
    """M3: area under ROC, accuracy and size of a held-out set, one row."""
    labelled = with_tokens(test.withColumn(label_col, F.col(label_col).cast("double")), text_col)
    pred = model.transform(labelled).select(F.col(label_col).alias("label"), vector_to_array("probability")[1].alias("score"), "prediction")
    return binary_metrics(pred)


def model_scorer(model: PipelineModel, text_col: str = "content") -> Callable[[DataFrame], DataFrame]:
    """M1 with the MLlib model: posts -> (id, sentiment, sentiment_score,
    analyze_status, error)."""
    def score(posts: DataFrame) -> DataFrame:
        out = model.transform(with_tokens(posts.select("id", text_col), text_col))
        p = vector_to_array("probability")
        return (out.select("id", decide(p[0], p[1]).alias("_d"))
                   .select("id", "_d.*", F.lit(1).alias("analyze_status"), F.lit(None).cast("string").alias("error")))

    return score


def score_posts(posts: DataFrame, model: PipelineModel) -> DataFrame:
    """M1 with the MLlib model: (id, sentiment, sentiment_score)."""
    return model_scorer(model)(posts).select("id", "sentiment", "sentiment_score")


def function_scorer(scorer: Callable, text_col: str = "content") -> Callable[[DataFrame], DataFrame]:
    """M1 with a user function ``scorer(pd.Series[str]) -> (p_neg, p_pos)``,
    called per Arrow batch.  Where it raises, the batch is scored row by row:
    only the rows that fail have status 2, with the error's message."""
    def score(posts: DataFrame) -> DataFrame:
        import numpy as np
        import pandas as pd

        def rows(texts):
            neg, pos = scorer(texts)
            return np.asarray(neg, dtype="float64"), np.asarray(pos, dtype="float64")

        def run(it):
            for pdf in it:
                n = len(pdf)
                status, error = np.ones(n, dtype="int32"), [None] * n
                try:
                    neg, pos = rows(pdf[text_col])
                except Exception:  # noqa: BLE001  (a text the scorer cannot take: find it)
                    neg, pos = np.full(n, np.nan), np.full(n, np.nan)
                    for i in range(n):
                        try:
                            a, b = rows(pdf[text_col].iloc[i:i + 1])
                            neg[i], pos[i] = a[0], b[0]
                        except Exception as e:  # noqa: BLE001  (kept with the row)
                            status[i], error[i] = 2, f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"id": pdf["id"].values, "p_neg": neg, "p_pos": pos, "analyze_status": status,
                                    "error": error})

        s = posts.select("id", text_col).mapInPandas(run, "id long, p_neg double, p_pos double, analyze_status int, error string")
        d, ok = decide(F.col("p_neg"), F.col("p_pos")), F.col("analyze_status") == 1
        return s.select("id", F.when(ok, d["sentiment"]).alias("sentiment"),
                        F.when(ok, d["sentiment_score"]).alias("sentiment_score"), "analyze_status", "error")

    return score


def analyse(posts: DataFrame, score: Callable[[DataFrame], DataFrame], top_n: int = 5) -> DataFrame:
    """Scores and top keywords of posts: (id, sentiment, sentiment_score,
    analyze_status, keywords)."""
    kw = (post_keywords(posts.select("id", "content"), top_n)
          .groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_k"))
          .select("id", F.transform("_k", lambda x: x["term"]).alias("keywords")))
    none = F.array().cast("array<string>")
    return (score(posts).join(kw, "id", "left")
            .select("id", "sentiment", "sentiment_score", "analyze_status", F.coalesce("keywords", none).alias("keywords")))


def analyze_batch(posts: DataFrame, score: Callable[[DataFrame], DataFrame], top_n: int = 5,
                  limit: int | None = None) -> DataFrame:
    """M4: pending posts scored and keyworded; the others as they are.  The
    table is split by status and put together again, only the pending part is
    joined with its results.  ``limit`` takes the oldest pending ids first, as the
    polling loop did (the others stay pending)."""
    base = posts
    for c, kind in (("sentiment_score", "float"), ("keywords", "array<string>")):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast(kind))
    is_pending = F.coalesce(F.col("analyze_status") == 0, F.lit(False))
    pend, rest = base.filter(is_pending), base.filter(~is_pending)
    if limit is not None:
        ids = cut(pend.select("id").orderBy("id").limit(limit))
        rest = rest.unionByName(pend.join(ids, "id", "left_anti").select(*base.columns))
        pend = pend.join(ids, "id", "left_semi").select(*base.columns)
    new = analyse(pend, score, top_n)
    fields = ["sentiment", "sentiment_score", "analyze_status", "keywords"]
    done = pend.drop(*fields).join(new, "id").select(
        *[F.col(c).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    return rest.unionByName(done)
