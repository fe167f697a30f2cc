"""The trigram index: no file that a rule hits is passed over, and only candidates are read."""

import glob
import os
import random
import re

import pytest

from warpsift.operators.candidates import may_hit
from warpsift.plans.audit import audit, indexed_scan
from warpsift.plans.late import LATE_RULES
from warpsift.rules.base import HIGH, PER_MATCH, Pattern, Rule, ci
from warpsift.rules.catalog import PACKS
from warpsift.schema import FINDING_COLUMNS
from warpsift.sources import corpus, files as sources, trigrams


def rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def stored(spark, tmp_path, files):
    path = str(tmp_path / "estate")
    sources.write_table(files, path)
    return path


def test_words_of_a_text_are_held(spark):
    rng = random.Random(4)
    chars = "abcXYZ019 _-.;(){}ÜßKKİ\u0085😀\n"
    texts = ["", "a", "ab", "abc", None, "x" * 70_000] + [
        "".join(rng.choice(chars) for _ in range(rng.randrange(200))) for _ in range(60)]
    words = ["", "ab", "abc", "ABC", "Üßk", "xyz0"] + [
        t[i:i + rng.randrange(2, 9)] for t in texts[6:] if t
        for i in [rng.randrange(len(t))]]
    files = spark.createDataFrame([(0, i, f"f{i}", f"/f{i}", t) for i, t in enumerate(texts)], (
        "repo_part int, repo_id bigint, path string, abs_path string, content string"))
    out = trigrams.indexed(files).selectExpr(
        "repo_id", "chars", *[f"{trigrams.holds(w)} AS w{i}" for i, w in enumerate(words)])
    passed = 0
    for r in out.collect():
        text = texts[r.repo_id] or ""
        assert r.chars == len(text)
        for i, w in enumerate(words):
            if w.lower() in text.lower():
                assert r[f"w{i}"], (w, text)
            passed += r[f"w{i}"]
    assert passed < 0.5 * len(texts) * len(words)


def test_sets_grow_with_the_text():
    small, large = trigrams.bits_of(b"abcabcabc"), trigrams.bits_of(os.urandom(99).hex().encode() * 9)
    assert len(small) == 1 and len(large) > 4 and len(large) & len(large) - 1 == 0
    assert trigrams.bits_of("äöü".encode()).tolist() == [0]


#: One pack of each kind of rule; the named query `indexed_packs` covers others.
@pytest.mark.parametrize("pack", ["prompts", "iac", "routes", "upload"])
def test_packs_through_the_index(spark, pack, estate):
    path, files = estate
    assert rows(indexed_scan(spark, path, [pack])) == rows(audit(files, [pack]))


@pytest.fixture(scope="module")
def estate(spark, tmp_path_factory):
    files = corpus.files(spark, "/root/testdata/sf0.001")
    return stored(spark, tmp_path_factory.mktemp("index"), files), files


def test_few_files_are_candidates(spark, estate):
    path, files = estate
    index = trigrams.read_index(spark, path)
    all_files = index.count()
    for rule in LATE_RULES:
        n = index.where(may_hit(rule)).count()
        assert 0 < n < 0.2 * all_files, rule.rule_id


def test_other_folders_are_never_opened(spark, tmp_path):
    """Folders without a candidate may hold anything."""
    path = stored(spark, tmp_path, corpus.files(spark, "/root/testdata/sf0.001"))
    word = ci(r"ZQXWBOT!!XPLOVERVJQ[a-z]+Y")
    rule = Rule("db", "one", HIGH, "c", "t", None, "title", "fix", all_of=(word,),
                none_of=(Pattern("nothing"),), line=word)
    hit = spark.createDataFrame([(5, "src/db.js", "/r5/src/db.js", "x\nzqxwbot!!xplovervjqaay")], (
        "repo_id bigint, path string, abs_path string, content string"))
    one = str(tmp_path / "one")
    sources.write_table(hit, one)
    # The same layout, so the file can be laid beside the others.
    for sub in ("", "/" + trigrams.FOLDER):
        (folder,) = glob.glob(f"{one}{sub}/repo_part=*")
        target = f"{path}{sub}/{os.path.basename(folder)}"
        os.makedirs(target, exist_ok=True)
        for f in glob.glob(f"{folder}/*.parquet"):
            with open(f, "rb") as a, open(f"{target}/more-{os.path.basename(f)}", "wb") as b:
                b.write(a.read())
    mine = os.path.basename(folder)
    spoiled = 0
    for f in glob.glob(f"{path}/repo_part=*/*.parquet"):
        if f"/{mine}/" not in f:
            with open(f, "wb") as out:
                out.write(b"spoiled")
            spoiled += 1
    assert spoiled > 10
    found = indexed_scan(spark, path, rules=[rule])
    assert [(r.repo_id, r.rule_id, r.line) for r in found.collect()] == [(5, "one", 2)]
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*repo_part", plan)


def test_odd_patterns_and_rules(spark, files_of, tmp_path):
    texts = {"src/a.js": "", "src/b.js": "ab", "src/c.js": "foo bar", "src/d.js": "FOO\nxbarx",
             "src/e.js": "fKo", "src/f.js": None, "README.txt": "foo bar",
             "src/k.js": "Kelvin kelvin"}
    path = stored(spark, tmp_path, files_of(texts))

    def found(**conditions):
        rule = Rule("owasp", "r", HIGH, "c", "t", None, "title", "fix", **conditions)
        got = indexed_scan(spark, path, rules=[rule])
        whole = audit(files_of(texts), ["owasp"], extra_rules=[rule]).where("rule_id = 'r'")
        assert rows(got.select(*FINDING_COLUMNS)) == rows(whole.select(*FINDING_COLUMNS))
        return sorted(r.path for r in got.collect())

    assert found(all_of=(ci("foo"), ci("bar"))) == ["src/c.js", "src/d.js"]
    assert found(all_of=(Pattern("foo|ab"),)) == ["src/b.js", "src/c.js"]
    assert found(all_of=(Pattern("[a-c]+x"),)) == []
    assert found(all_of=(Pattern("fo?o.?b|xb"),)) == ["src/c.js", "src/d.js"]
    assert found(none_of=(ci("foo"),), longer_than=1) == ["src/b.js", "src/e.js", "src/k.js"]
    assert found(all_of=(ci("kelvin"),)) == ["src/k.js"]
    assert found(path_all=(Pattern(r"/c\.js$"),)) == ["src/c.js"]
    assert found(all_of=(Pattern("o"),), emits=PER_MATCH) == ["src/c.js", "src/c.js", "src/e.js"]
    with pytest.raises(ValueError):
        indexed_scan(spark, path, ["env"])
    with pytest.raises(ValueError):
        indexed_scan(spark, path, rules=[PACKS["routes"][0]])
