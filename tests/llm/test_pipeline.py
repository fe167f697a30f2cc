import collections
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm import test_neardup, test_sentences
from tests.llm.conftest import doc
from tests.llm.test_packing import whole
from warpsift.llm import mixing, toxicity
from warpsift.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """What each stage returns, written and read again as the next one's documents."""
    root, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{root}/{k}/documents.parquet")
        out.append(spark.read.parquet(f"{root}/{k}/documents.parquet"))
    return root, out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_stages_and_columns(kept):
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
    assert all(df.columns == kept[1][0].columns for df in kept[1][:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, sf_dir, kept):
    before, after = kept[1][:2]
    model = toxicity.learn(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = sorted(i for i, t in pairs(before) if toxicity.score_texts([t], model)[0] < 0.5)
    assert [i for i, _ in pairs(after)] == want and 0 < len(want) < before.count()


def test_one_of_each_near_group_stays(kept):
    before, after = kept[1][1:3]
    assert [i for i, _ in pairs(after)] == sorted(set(test_neardup.plain(pairs(before)).values()))


def test_repeated_spans_go(kept):
    before, after = kept[1][2:4]
    want = test_sentences.plain(pairs(before))
    assert dict(pairs(after)) == {k: v[0] for k, v in want.items()}
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text is not None)


def test_documents_are_repeated_as_the_mix_says(kept):
    root, out = kept
    rows = [(r.doc_id, r.source, r.text) for r in out[3].collect()]
    sizes = collections.Counter()
    for _, source, text in rows:
        sizes[source] += len((text or "").split())
    names = sorted(sizes)
    targets = dict(zip(names, mixing.fill_targets(
        [sizes[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    copies = collections.Counter(r.doc_id for r in out[4].collect())
    taken = collections.Counter()
    for key, source, text in rows:
        taken[source] += copies[key] * len((text or "").split())
    assert max(copies.values()) <= 3
    for n in names:
        largest = max(len((t or "").split()) for _, s, t in rows if s == n)
        assert abs(targets[n] - taken[n]) <= largest


def test_pieces_hold_every_id_once(kept):
    texts = [r.text for r in kept[1][4].collect()]
    packed = kept[1][5].collect()
    assert sum(r.length for r in packed) == sum(len(whole(t)) for t in texts)
    assert len({r.sequence_id for r in packed}) <= sum(r.length for r in packed) / 4096 * 1.03 + 1


def test_run_gives_the_last_stage(spark, sf_dir, kept, rows_of):
    assert rows_of(cp.run(spark, sf_dir)) == rows_of(kept[1][5])


def test_odd_and_empty_tables(spark, odd_docs, no_docs, tables):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, None)],
                                   "doc_id bigint, quality int, toxic int")
    extra = odd_docs.selectExpr("*", *[f"{i} as {name}" for i, name in enumerate(
        "size target flow copies taken pattern_size n_sentences n_removed th c1 score".split())])
    for docs in (odd_docs, extra):
        rows = cp.run(spark, tables(docs, labels)).collect()
        # A document of 80,000 words is more than the mix wants of its source.
        assert {8, 9} <= {r.doc_id for r in rows} <= {1, 2, 3, 4, 5, 6, 8, 9, None}
    assert cp.run(spark, tables(no_docs, labels)).count() == 0
    assert cp.run(spark, tables(spark.createDataFrame(
        [doc(1, None, None)], odd_docs.schema))).count() >= 0


def test_every_operator_has_a_query():
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in QUERIES) == 1
    assert set(ORACLES) <= set(QUERIES) and "pipeline" in QUERIES


def test_the_rest_stands_without_the_operators():
    """The entry imports when the optional part is gone; other missing modules are errors."""
    code = textwrap.dedent("""
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name == GONE or name.startswith(GONE + "."):
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert e.queries() and not any(k.startswith("op1_") for k in e.queries())
    """)
    run = lambda gone: subprocess.run([sys.executable, "-c", f"GONE = {gone!r}{code}"],
                                      capture_output=True).returncode
    assert run("warpsift.llm") == run("corpus_pipeline") == 0 and run("xxhash") != 0


def test_stages_carry_extra_columns(spark, odd_docs, tables):
    extra = odd_docs.withColumns({"size": F.lit(7), "copies": F.col("doc_id") + 1,
                                  "n_removed": F.lit("x")})
    folder = tables(extra)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (cp.drop_near_copies, cp.drop_repeated_spans, cp.mix_sources):
        docs = stage(spark, docs, folder)
        assert docs.columns == extra.columns
        for r in docs.collect():
            assert r["size"] == 7 and r.n_removed == "x"
            assert r.copies == (None if r.doc_id is None else r.doc_id + 1)
