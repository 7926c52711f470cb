"""Cases of the contracts that were once missed."""


def test_license_hits_far_apart_do_not_add_up(spark):
    from riskspark.llm import licenses as S

    far = "released under " + "under the " * 1000 + "the mit"
    rows = [(1, far), (2, "released under the mit license"), (3, "released under the good old mit license"),
            (4, "released under " + "word " * 50 + "the mit license")]
    got = {r.doc_id: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "" and got[1].score < S.SHARE
    assert got[2].labels == "mit,notice-mit" and got[2].score == 1.0
    assert got[3].labels == "mit,notice-mit" and got[3].n_base == 1
    assert got[4].labels == "mit" and got[4].n_base == 1
