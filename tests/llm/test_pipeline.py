import corpus_pipeline
from marquee.llm.common import table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string, __text string, row int, bin int"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", "y", 1, 2) for d, t in rows], COLUMNS)


def test_stages_keep_odd_rows_and_columns(spark, sf):
    item = table(spark, sf, "benchmark").where("text IS NOT NULL").orderBy("item_id").first().text
    long = " ".join(f"w{i}" for i in range(40))
    docs = _docs(spark, [(1, long), (2, long + " end"), (2, long + " end"), (None, long), (None, None), (3, ""), (4, f"start {item} stop"), (5, "key: password = hunter22secret now"), (6, " ".join(f"v{i}" for i in range(5000)))])
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == 9
    unique = stages["ngram_join"](spark, docs, sf)
    assert unique.columns == docs.columns and sorted(r.doc_id or 0 for r in unique.collect()) == [0, 0, 1, 3, 4, 5, 6]
    clean = stages["decontamination"](spark, docs, sf)
    assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 0, 1, 2, 2, 3, 5, 6]
    masked = {r.doc_id: r for r in stages["secrets"](spark, docs.where("doc_id <> 2"), sf).collect()}
    assert masked[5].text == "key: [SECRET] now" and masked[5].n_chars == len(masked[5].text) and masked[5].spans == "x" and masked[3].text == ""
    pieces = stages["packing"](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == {None, 1, 2, 3, 4, 5, 6} and sum(r.doc_id == 6 for r in pieces) > 1
    assert all(f(spark, docs.limit(0), sf).count() == 0 for f in stages.values())


def test_ngram_stage_keeps_one_document_of_each_component(spark, sf):
    from marquee.llm import ngram_join

    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {c for _, c in ngram_join.brute_force(rows).values()}
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, sf).collect()) == sorted(want)
