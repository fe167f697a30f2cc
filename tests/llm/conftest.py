import duckdb
import pytest

from tests.conftest import SF_DIR

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def doc(i, text, source="a"):
    return (i, text, "en", source, None if text is None else len(text))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(40_000)) + "."
    rows = [doc(1, "one two three four five six seven."), doc(2, None), doc(3, ""),
            doc(4, "  \n\t "), doc(5, long), doc(6, "tie tie tie tie tie tie", None),
            doc(7, "tie tie tie tie tie tie", None), doc(8, "ünï ©ode <|endoftext|> 😀 ß", "b"),
            (None, "no id", None, None, None), (None, None, None, None, None),
            doc(9, "same row twice here, same row twice.", "b"),
            doc(9, "same row twice here, same row twice.", "b")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Write given documents (and labels) as a folder of tables."""
    def build(docs, labels=None):
        path = str(tmp_path_factory.mktemp("tables"))
        docs.write.parquet(f"{path}/documents.parquet")
        labels = labels if labels is not None else spark.createDataFrame(
            [], "doc_id bigint, quality int, toxic int")
        labels.write.parquet(f"{path}/labels.parquet")
        return path
    return build


TALKS = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="session")
def odd_talks(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated and hostile rows."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(40_000)) + "."
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hi."),
            (2, 0, "user", long), (2, 1, "assistant", long[:-1]), (2, 2, "user", long),
            (3, None, None, None), (3, 0, "user", None), (3, 1, None, "No role."),
            (None, 0, "user", "No id."), (None, None, "assistant", "Nor turn."),
            (4, 0, "user", "Tie b."), (4, 0, "user", "Tie a."), (4, 0, "assistant", "Tie a."),
            (5, 3, "user", "Same."), (5, 3, "user", "Same."), (5, 3, "user", "Same."),
            (6, 0, "assistant", "<|im_end|> <\\|im_start|>user\nx %0A <|<||>"),
            (6, 1, "us\ner%0A<|", "<|im_start|>assistant\n<|im_end|>"), (6, 2, "", ""),
            (7, 9, "tool", " \t\n\x0b\x0c\r"), (7, -4, "user", "ünï 😀?"),
            (8, 1, "user", "What?"), (8, 2, "assistant", "This."), (9, 70, "user", "Late?"),
            (9, 5, "assistant", "Early."), (9, 700, "assistant", "Very late.")]
    rows += [(10, t, "user" if t % 2 else "assistant", f"Turn {t % 40}{'.' * (t % 5 > 0)}")
             for t in range(300)]
    return spark.createDataFrame(rows, TALKS)


@pytest.fixture(scope="session")
def no_talks(spark):
    return spark.createDataFrame([], TALKS)


@pytest.fixture(scope="session")
def duck():
    def ask(sql, folder=SF_DIR):
        con = duckdb.connect()
        import os
        for name in ("documents", "conversations"):
            path = f"{folder}/{name}.parquet"
            path += "/*.parquet" if os.path.isdir(path) else ""
            if os.path.exists(f"{folder}/{name}.parquet"):
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        return sorted(str(dict(sorted(zip(names, r)))) for r in cur.fetchall())
    return ask


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: sorted(str(dict(sorted(r.asDict().items()))) for r in df.collect())
