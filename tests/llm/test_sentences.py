import re

import pytest
from pyspark.sql import functions as F

from warpsift.llm import sentences as sen
from tests.llm.conftest import doc

WS = "\t\n\f\r "


def plain(rows):
    """(text, sentences, removed) of each row, by a table of all runs."""
    cut = [re.findall(sen.SENTENCE, t or "") for _, t in rows]
    first, gone = {}, [set() for _ in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i in order:
        s = [x.strip(WS) for x in cut[i]]
        for p in range(len(s) - sen.RUN + 1):
            run = next((s[p:p + n] for n in (3, 4, 5, 6, 12, 24, 48)
                        if len("\n".join(s[p:p + n])) >= sen.LEAST_CHARS), None)
            if run and first.setdefault("\n".join(run), (i, p)) != (i, p):
                gone[i].update(range(p, p + len(run)))
    return {key: (text if not gone[i] else "".join(
        x for p, x in enumerate(cut[i]) if p not in gone[i]), len(cut[i]), len(gone[i]))
        for i, (key, text) in enumerate(rows)}


def result(df):
    return {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in df.collect()}


def test_query_equals_sql(spark, sf_dir, duck, rows_of):
    assert rows_of(sen.op4_sentence_spans(spark, sf_dir)) == duck(sen.OP4_SQL)


def test_against_a_table_of_all_runs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(sen.op4_sentence_spans(spark, sf_dir)) == plain(rows)


def test_sentences_join_to_the_text(spark, odd_docs):
    rows = odd_docs.withColumn("s", F.array_join(sen.sentences_of(F.col("text")), "")).collect()
    assert all(r.s == (r.text or "") or not (r.text or "").strip() for r in rows)


@pytest.mark.parametrize("passage", [
    " ".join(f"passage{i}" for i in range(60)),
    ". ".join(" ".join(f"part{j}x{i}" for i in range(9)) for j in range(7)) + "."])
def test_passages_of_over_fifty_words_go(spark, passage):
    text = lambda k: f"Own words of document {k} come here. {passage}\nAnd {k} ends so."
    docs = spark.createDataFrame([doc(k, text(k)) for k in range(30)])
    out = result(sen.dedup_spans(docs.toDF("doc_id", "text", "lang", "source", "n_chars")))
    assert out[0][0] == text(0)
    for k in range(1, 30):
        left = out[k][0]
        assert f"document {k} come here." in left and f"And {k} ends so." in left
        assert sum(w in left for w in passage.split()) <= 12


def test_passages_inside_other_sentences_go(spark):
    """Between words of other sentences, at another place each time."""
    passage = ("Green hills rise behind the old town, and a river winds down from them to the sea. "
               "Boats lie along its banks, painted in blue, white and red. In the evening people "
               "walk there, talk of the day, and watch the lights come on across the water. Later "
               "the wind turns, the boats swing round, and all is still.")
    own = lambda k, n: " ".join(f"own{k}x{i}" for i in range(n))
    docs = spark.createDataFrame([doc(k, f"{own(k, 3 + k)} {passage} {own(-k, 9)}")
                                  for k in range(12)])
    out = result(sen.dedup_spans(docs.toDF("doc_id", "text", "lang", "source", "n_chars")))
    assert passage in out[0][0]
    for k in range(1, 12):
        left = out[k][0]
        assert own(k, 3 + k) in left and left.endswith(own(-k, 9))
        # Only what shares a sentence with the words before it is left.
        assert not [s for s in ("a river winds", "Boats lie", "In the evening", "Later",
                                "all is still") if s in left]


def test_short_runs_and_single_sentences_stay(spark):
    line = "The same long line of boilerplate stands in each and every document here."
    docs = spark.createDataFrame([doc(k, f"Word {k} is. {line} Then {k} comes. To. In. Of.")
                                  for k in range(20)])
    assert all(r[2] == 0 for r in result(sen.dedup_spans(docs.toDF(
        "doc_id", "text", "lang", "source", "n_chars"))).values())


def test_odd_rows(spark, odd_docs, no_docs):
    out = sen.dedup_spans(odd_docs)
    rows = out.collect()
    assert out.columns == [*odd_docs.columns, "n_sentences", "n_removed"]
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.text is None or not r.text.strip():
            assert (r.n_sentences, r.n_removed) == (0, 0)
    twice = [r for r in rows if r.doc_id == 9]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].text
    assert sum(r.text is None for r in rows) == 2
    assert sen.dedup_spans(no_docs).count() == 0
    named = odd_docs.withColumns({"_s": F.lit(1), "_gone": F.lit("x"), "_key": F.lit(2)})
    assert sen.dedup_spans(named).count() == 12
    with pytest.raises(ValueError):
        sen.dedup_spans(odd_docs.withColumnRenamed("lang", "N_Removed"))


def test_null_and_repeated_ids(spark):
    text = ". ".join(f"alpha{i} beta{i} gamma{i} delta{i}" for i in range(12)) + "."
    docs = spark.createDataFrame([doc(None, text), doc(3, text), doc(3, text), doc(3, "other")])
    rows = sen.dedup_spans(docs.toDF("doc_id", "text", "lang", "source", "n_chars")).collect()
    assert sorted((str(r.doc_id), r.text == text, r.text) for r in rows) == sorted(
        [("None", True, text), ("3", False, ""), ("3", False, ""), ("3", False, "other")])


@pytest.mark.parametrize("passage", [
    ", ".join(f"w{i}" for i in range(120)), "\n".join(f"line {i}" for i in range(60)),
    " ".join(f"loud{i}!!" for i in range(60))])
def test_passages_of_very_short_sentences_go(spark, passage):
    docs = spark.createDataFrame([doc(k, f"Document {k} begins.\n{passage}\nThen {k} ends.")
                                  for k in range(4)])
    out = result(sen.dedup_spans(docs.toDF("doc_id", "text", "lang", "source", "n_chars")))
    assert passage in out[0][0]
    for k in range(1, 4):
        left = out[k][0]
        assert f"Document {k} begins." in left and f"Then {k} ends." in left
        assert len(left) < 80


def test_query_equals_sql_where_ids_are_shared_or_missing(spark, sf_dir, duck, rows_of, tmp_path):
    """A third of the rows without an id, others sharing one, and rows that stand twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 5 == 0, 7).otherwise(
        F.col("doc_id"))
    odd = docs.withColumn("doc_id", key).unionByName(
        docs.where("doc_id % 7 = 1").withColumn("doc_id", F.lit(None).cast("long")))
    orders = [odd, odd.orderBy("text"), odd.repartition(5, F.length("text"))]
    found = []
    for n, rows in enumerate(orders):
        folder = str(tmp_path / str(n))
        rows.write.parquet(f"{folder}/documents.parquet")
        found.append(rows_of(sen.op4_sentence_spans(spark, folder)))
    assert found[0] == found[1] == found[2] == duck(sen.OP4_SQL, folder)
    assert sum("'n_removed': 0" not in r for r in found[0]) > 10


def test_a_span_in_every_document_is_dealt_out(spark):
    """The commonest span has far more than a task's share of the rows."""
    line = ", ".join(f"common{i} words{i} in{i} all{i}" for i in range(9)) + "."
    docs = spark.createDataFrame([doc(k, f"Own {k} begins. {line} Own {k} ends; {k}.")
                                  for k in range(300)])
    docs = docs.toDF("doc_id", "text", "lang", "source", "n_chars")
    out = result(sen.dedup_spans(docs))
    assert out == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert out[0][2] == 0 and all(out[k][2] >= 8 for k in range(1, 300))
