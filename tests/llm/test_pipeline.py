"""The pipeline's stages, each held against a plain version on its own input."""

from corvane.llm.shared import cut
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_with_awkward_rows(spark):
    """Null and repeated ids, null and empty texts, copies, more columns with names of the operators' own: nothing is lost that should stay."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 12").select("doc_id", "text", "lang", "source", "n_chars")
    prose = docs.where("length(text) > 200").orderBy("doc_id").first().text
    rows = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, prose, "en", "s", 1), (902, prose[: len(prose) // 2], "en", "s", 1), (None, prose + " end", "en", "s", 1), (903, prose, None, None, None)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for c in ("row", "own_text", "kept", "place", "odd", "id", "_row", "spread", "items", "hits", "score", "accepted", "n", "piece", "name"):
        odd = odd.withColumn(c, odd.doc_id * 0 + 7)
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, odd, SF), "test")
        found = [r.doc_id for r in out.collect()]
        if name == "packing":
            assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
            assert len(found) >= odd.count() and found.count(None) == 1 and found.count(902) == 2
        else:
            assert out.columns == odd.columns
        if name == "near_dedup":
            assert found.count(None) == 0 and 903 not in found and {900, 901} <= set(found)
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = cut(stage(spark, docs, SF), "test")
        after = {r.doc_id: r.text for r in out.collect()} if name != "packing" else None
        seen[name] = before, after
        if name != "packing":
            assert out.columns == columns and set(after) <= set(before)
        docs = out if name != "packing" else docs
    assert len(seen["language_id"][1]) >= 0.98 * len(seen["language_id"][0])
    before, after = seen["near_dedup"]
    assert set(after) == {d for d, (_, c) in brute.near_duplicates(before, 5).items() if d == c}
    before, after = seen["substring_dedup"]
    plain = brute.word_repeats(before)
    assert set(after) == {d for d, (n, gone, _) in plain.items() if not n or gone < n}
    assert all(after[d] == before[d] if not plain[d][1] else brute.sha(after[d]) == plain[d][2] for d in after)
    before, after = seen["decontamination"]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert set(after) == {d for d, x in brute.contamination(before, items).items() if not x[1]}
