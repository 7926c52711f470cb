"""Registered queries, fourth part: training data, splits, evaluation,
forest training and scoring (rows-only), frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import rules
from riskspark.operators import frames as FR
from riskspark.operators import scoring as SC
from riskspark.operators import training as TN
from riskspark.session import written
from riskspark.sources import fixtures as FX


def _prep(spark, sf_dir):
    posts = FX.posts(spark, sf_dir, spread=True)
    return TN.train_prep(posts.join(FX.training_labels(spark, sf_dir), "post_id", "left"))


def _strat(spark, sf_dir):
    return TN.split_stratified(_prep(spark, sf_dir), "post_id")


def _strat_labels(spark, sf_dir):
    return TN.split_labels(_prep(spark, sf_dir), "post_id")


def _fixture_pred(df):
    p = FX.fixture_rf_probability("post_id")
    return df.withColumn("pred", SC.rf_label(p[0], p[1], p[2]))


def q_train_prep(spark, sf_dir):
    return _prep(spark, sf_dir)


def q_train_prep_v1(spark, sf_dir):
    return TN.train_prep_v1(FX.posts(spark, sf_dir, spread=True))


def q_split_plain(spark, sf_dir):
    return TN.split_plain(TN.train_prep_v1(FX.posts(spark, sf_dir, spread=True)), "post_id").select("post_id", "risk_label", "split")


def q_split_stratified(spark, sf_dir):
    return _strat_labels(spark, sf_dir)


def q_confusion(spark, sf_dir):
    test = _strat_labels(spark, sf_dir).filter(F.col("split") == "test")
    return TN.confusion(_fixture_pred(test))


def q_class_report(spark, sf_dir):
    test = _strat_labels(spark, sf_dir).filter(F.col("split") == "test")
    return TN.class_report(_fixture_pred(test))


def q_frame_features(spark, sf_dir):
    return FR.frame_features(FX.frames(spark, sf_dir))


def q_colour_features(spark, sf_dir):
    return FR.frame_features(FX.colour_frames(spark, sf_dir), pixels="bgr", colour=True)


def q_frame_blur(spark, sf_dir):
    s = FR.frame_stats(FX.frames(spark, sf_dir))
    return s.select("video_id", "frame", FR.N.round_half_away(F.col("brightness"), 6).alias("brightness"),
                    FR.N.round_half_away(F.col("blur"), 6).alias("blur"))


# --- forest training and scoring (rows-only: forests differ by engine) ------

def _fit_v2(spark, sf_dir):
    # read by the cut points, the counts, the model key, both vocabularies and the forest: cleaned once
    split = TN.split_stratified(written(_prep(spark, sf_dir), "prep"), "post_id")
    TN.require_rows(split)
    train = TN.balanced_weights(split.filter(F.col("split") == "train"))
    return TN.fit_or_load(TN.pipeline_v2(), train), split


def q_train_v1(spark, sf_dir):
    d = TN.split_plain(TN.train_prep_v1(FX.posts(spark, sf_dir, spread=True)), "post_id")
    model = TN.pipeline_v1(text_col="full_text", label_col="risk_label").fit(d.filter(F.col("split") == "train"))
    out = TN.rf_probability_columns(model, d.filter(F.col("split") == "test"), "full_text")
    p = [F.col("__rf_probs")[i] for i in range(3)]
    return out.select("post_id", F.col("risk_label").alias("label"), SC.rf_label(*p).alias("pred"),
                      SC.rf_score(*p).alias("rf_score"))


def q_train_v2(spark, sf_dir):
    model, split = _fit_v2(spark, sf_dir)
    out = TN.rf_probability_columns(model, split.filter(F.col("split") == "test"), "text")
    p = [F.col("__rf_probs")[i] for i in range(3)]
    return out.select("post_id", "label", SC.rf_label(*p).alias("pred"), SC.rf_score(*p).alias("rf_score"))


def q_rf_scores(spark, sf_dir):
    """Fit on the training split, then score every post with the fitted
    pipeline (one transform; label and score from the same probabilities)."""
    model, _ = _fit_v2(spark, sf_dir)
    posts = FX.posts(spark, sf_dir, spread=True)
    scored = SC.score_posts(posts, rf_model=model)
    return scored.select("post_id", "rf_risk_label", "rf_risk_score", "mm_risk", "mm_risk_level")


def q_rf_check(spark, sf_dir):
    """Per post: model label, score and the number of known terms (nnz) of the
    whole feature vector, words and character n-grams."""
    from riskspark.operators import features as FE

    model, _ = _fit_v2(spark, sf_dir)
    posts = FX.posts(spark, sf_dir, spread=True)
    text = posts.select("post_id", FE.model_text(posts).alias("text"))
    out = TN.rf_probability_columns(model, text, "text", nnz="tfidf_nnz")
    p = [F.col("__rf_probs")[i] for i in range(3)]
    return out.select("post_id", SC.rf_label(*p).alias("rf_label_test"), SC.rf_score(*p).alias("rf_score_test"), "tfidf_nnz")


def q_rf_confusion(spark, sf_dir):
    """Confusion matrix of the fitted model on the rows it has not seen."""
    return TN.confusion(q_train_v2(spark, sf_dir))


def q_rf_report(spark, sf_dir):
    """Precision, recall and f1 of the fitted model on the rows it has not seen."""
    return TN.class_report(q_train_v2(spark, sf_dir))


def q_rf_data_check(spark, sf_dir):
    """The fitted model over all posts, in one table of (measure, value): rows
    per predicted label, posts without a known term, and the summaries of
    score and number of known terms."""
    from pyspark import StorageLevel

    from riskspark.operators import report as RP

    out = q_rf_check(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    measure = lambda name, value: F.struct(name.alias("measure"), value.cast("double").alias("value"))
    parts = [RP.value_counts(out, "rf_label_test").select(
        measure(F.concat(F.lit("label "), F.coalesce("rf_label_test", F.lit("none"))), F.col("n")).alias("r"))]
    parts.append(out.agg(F.count_if(F.col("tfidf_nnz") == 0).alias("n")).select(measure(F.lit("nnz == 0"), F.col("n")).alias("r")))
    for col in ("rf_score_test", "tfidf_nnz"):
        d = RP.describe(out, col)
        parts.append(d.select(F.explode(F.array(*[measure(F.lit(f"{col} {c}"), F.col(c)) for c in d.columns])).alias("r")))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    return table.select("r.*")


def registry():
    return {
        "rf_confusion": q_rf_confusion,
        "rf_report": q_rf_report,
        "rf_data_check": q_rf_data_check,
        "train_prep": q_train_prep,
        "train_prep_v1": q_train_prep_v1,
        "split_plain": q_split_plain,
        "split_stratified": q_split_stratified,
        "confusion": q_confusion,
        "class_report": q_class_report,
        "frame_features": q_frame_features,
        "frame_blur": q_frame_blur,
        "colour_features": q_colour_features,
        "train_v1": q_train_v1,
        "train_v2": q_train_v2,
        "rf_scores": q_rf_scores,
        "rf_check": q_rf_check,
    }


__all__ = ["registry", "rules"]
