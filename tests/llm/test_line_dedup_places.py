"""Documents from which nothing is cut."""

from riskloom.llm import linededup


def test_texts_without_cuts_are_not_taken_apart(spark):
    texts = ["", "\n", "a\n\nb", "é\n漢\r\n", None, "no break"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = linededup.dedup_lines(docs)
    got = {r.doc_id: (r.lines_before, r.lines_deleted, r.words_deleted, r.text) for r in found.collect()}
    assert got == {k: (0 if t is None else len(t.split("\n")), 0, 0, t) for k, t in enumerate(texts)}
    branch = found._jdf.queryExecution().optimizedPlan().toString().split("Union", 1)[1].split("Join LeftOuter")
    assert any("octet_length" in part and "split(" not in part for part in branch)
