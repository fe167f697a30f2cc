import random
import re

from hypothesis import given, settings, strategies as st

from warpsift.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """Counts by looking at every place of the word list."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    places = [(i, label) for phrase, label in lic.PHRASES for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["GNU", "general", "public", "License", "mit", "CC", "by", "é",
                                 "apache", "x", "İ", "-", "\n", "4.0", "mit license", "😀"]),
                max_size=25), st.sampled_from([" ", "-", ", ", "\x00", "\x7f"]))
def test_exact_phrases(words, gap):
    text = gap.join(words)
    assert lic.scan_text(text)[:5] == plain(text)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edited_notices_are_found():
    """No candidate is lost: notices with the allowed number of edits, anywhere in a text."""
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    filler = lambda n: " ".join("".join(r.choice("qxzj") for _ in range(4)) for _ in range(n))
    for notice, label in lic.NOTICES:
        edits = max(1, min(lic.MOST_EDITS, len(notice) // lic.CHARS_PER_EDIT))
        for _ in range(40):
            text = notice
            for _ in range(edits):
                i = r.randrange(1, len(text) - 1)
                text = r.choice([text[:i] + text[i + 1:], text[:i] + r.choice(letters) + text[i:],
                                 text[:i] + r.choice(letters) + text[i + 1:]])
            if distance(notice, " ".join(text.split())) > edits:
                continue            # an edit may leave two spaces, which become one
            found = lic.scan_text(f"{filler(30)} {text.upper()}; {filler(30)}")
            assert label in found[5].split(","), (text, found)
            assert 0 < found[6] <= 1


def test_spans_point_into_the_text():
    text = "Ünder: the GNU, Genral\n Public LICENSE! ok"
    span, = lic.scan_text(text)[7]
    assert text[span["start"]:span["end"]] == span["found"] == "GNU, Genral\n Public LICENSE"
    assert span["edits"] == distance("gnu general public license", "gnu genral public license") == 1
    assert lic.scan_text("nothing of that kind")[5:] == ("", 0.0, [])


def test_odd_rows(spark, odd_docs, no_docs, tables):
    rows = lic.op3_notices(spark, tables(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.n_words, r.n_base, r.labels, r.score) for r in rows if r.doc_id in (2, 3, 4)} == {
        (0, 0, "", 0.0)}
    assert lic.find_notices(no_docs).count() == 0
    out = lic.find_notices(odd_docs.withColumnRenamed("lang", "labels"))
    assert out.count() == odd_docs.count()


def test_query_against_plain_counts(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in
             spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in lic.op3_notices(spark, sf_dir).collect():
        assert tuple(r)[1:6] == plain(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_many_finds_in_one_text():
    assert lic.scan_text("gnu general public license " * 3000)[1] == 3000


def test_edited_licence_lines_of_the_documents():
    for line, label in (("Licensed under the Apache Licence, Version 2.0.", "apache"),
                        ("See the Apache Licence.", "apache"),
                        ("Released under the MIT Licence.", "mit"),
                        ("Licensd under the MIT Licence.", "mit"),
                        ("Licensed uder CC BY-NC 4.0.", "cc-by"),
                        ("This work is licensed under the GNU Genral Public Licence.", "gpl"),
                        ("All rigts reserved.", "reserved")):
        assert lic.scan_text(f"Some words. {line}\nMore.")[5] == label, line
    assert lic.scan_text("They submit license forms, permit licences and limit license use.")[5] == ""


def test_notices_begin_and_end_with_words():
    for text in ("see licensed under cc bynow", "unlicensed under cc bygone", "xgnu general public license",
                 "the mit licensework", "callapache licensed"):
        assert all(text[s["end"]:s["end"] + 1] in ("", " ") and text[:s["start"]][-1:] in ("", " ")
                   for s in lic.scan_text(text)[7]), text
    assert lic.scan_text("see licensed under cc bynow")[5] == ""
    span, = lic.scan_text("so licensed under cc b now")[7]
    assert (span["found"], span["edits"]) == ("licensed under cc b", 1)
    long = "x" * 300_000
    assert lic.scan_text(f"{long} the mit license{long} gnu general public license {long}")[5] == "gpl"


def test_spans_come_with_the_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in
             spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = lic.op3_notices(spark, sf_dir).where("size(spans) > 0").collect()
    assert rows
    for r in rows:
        for s in r.spans:
            assert texts[r.doc_id][s.start:s.end] == s.found and s.label in r.labels.split(",")
