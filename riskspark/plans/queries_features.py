"""Registered queries, third part: n-grams, TF-IDF, vocabulary, OOV."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import features as FE
from riskspark.operators import training as TN
from riskspark.plans.strategy import join_small
from riskspark.session import written
from riskspark.sources import fixtures as FX


def corpus(spark, sf_dir):
    """(post_id, text): the training text of every post."""
    p = FX.posts(spark, sf_dir, spread=True)
    return p.select("post_id", FE.model_text(p).alias("text"))


def labelled_corpus(spark, sf_dir):
    lab = FX.training_labels(spark, sf_dir)
    return corpus(spark, sf_dir).join(lab, "post_id", "left_semi")


def q_word_ngrams(spark, sf_dir):
    return FE.term_summary(FE.term_lists(corpus(spark, sf_dir), "post_id", "text", "word"), "post_id")


def q_char_ngrams(spark, sf_dir):
    return FE.term_summary(FE.term_lists(corpus(spark, sf_dir), "post_id", "text", "char"), "post_id")


def q_tfidf_vocab(spark, sf_dir):
    c = corpus(spark, sf_dir)
    vocab = FE.vocabulary(FE.term_counts(c, "post_id", "text", "word"), c.count(), FE.V2_WORD, "post_id")
    return vocab.select("term", "df", "total", FE.N.round_half_away(F.col("idf"), 9).alias("idf"))


def q_tfidf_word(spark, sf_dir):
    """Features of the first trainer: words of caption and transcript as they are."""
    posts = TN.train_prep_v1(FX.posts(spark, sf_dir, spread=True))
    w, _ = FE.tfidf(posts, "post_id", "full_text", FE.V1_WORD)
    return FE.round_weights(w)


def _union(spark, sf_dir):
    c = written(corpus(spark, sf_dir), "corpus")     # read by four passes, cleaned once
    n = c.count()
    ww, _ = FE.tfidf(c, "post_id", "text", FE.V2_WORD, n)
    wc, _ = FE.tfidf(c, "post_id", "text", FE.V2_CHAR, n)
    return c, ww.withColumn("space", F.lit("word")).unionByName(wc.withColumn("space", F.lit("char")))


def q_tfidf_union(spark, sf_dir):
    _, u = _union(spark, sf_dir)
    return u.groupBy("post_id", "space").agg(
        F.count(F.lit(1)).alias("nnz"), FE.N.round_half_away(F.sum("weight"), 6).alias("weight_sum"))


def q_tfidf_nnz(spark, sf_dir):
    c, u = _union(spark, sf_dir)
    return FE.nnz(u, c, "post_id")


def q_oov_summary(spark, sf_dir):
    """Vocabulary fitted on the labelled posts, applied to every post:
    documents with no known term, and distinct unknown terms (anti join)."""
    lab = FX.training_labels(spark, sf_dir).select("post_id").distinct().withColumn("labelled", F.lit(True))
    c = written(corpus(spark, sf_dir).join(lab, "post_id", "left").withColumn("labelled", F.col("labelled").isNotNull()),
                "corpus")
    counts = FE.term_counts(c, "post_id", "text", "word", keep=("labelled",))
    stats = FE.oov_stats(counts, "labelled")        # first pass over the texts
    vocab = FE.vocabulary_of(stats, c.where("labelled").select("post_id").count(), FE.V2_WORD).select("term").cache()
    known = join_small(counts, vocab, "term")       # second pass
    per_doc = FE.nnz(known.withColumnRenamed("tf", "weight"), c, "post_id")
    unknown = stats.select("term").join(vocab, "term", "left_anti")
    # documents and unknown terms in one stream, summarised by one global
    # aggregation (one job; each side only fills its own column)
    rows = per_doc.select("nnz", F.lit(None).cast("string").alias("term")).unionByName(
        unknown.select(F.lit(None).cast("bigint").alias("nnz"), "term"))
    return rows.agg(F.count("nnz").alias("n_docs"), F.count_if(F.col("nnz") == 0).alias("n_zero_nnz"),
                    FE.N.round_half_away(F.avg("nnz"), 6).alias("mean_nnz"),
                    F.count("term").cast("bigint").alias("n_unknown_terms"))


def registry():
    return {
        "word_ngrams": q_word_ngrams,
        "char_ngrams": q_char_ngrams,
        "tfidf_vocab": q_tfidf_vocab,
        "tfidf_word": q_tfidf_word,
        "tfidf_union": q_tfidf_union,
        "tfidf_nnz": q_tfidf_nnz,
        "oov_summary": q_oov_summary,
    }
