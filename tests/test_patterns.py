"""The compiled form of every catalog pattern against a plain regular expression."""

import re

from hypothesis import Phase, given, settings, strategies as st

from warpsift.functions.patterns import Text, ascii_lower, branches, plan, same_line_parts, \
    tokens, without_nel
from warpsift.rules.catalog import PACKS

SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_EOL = "[^\n\r\u2028\u2029]"
ALL = sorted({p for rules in PACKS.values() for r in rules
              for p in (*r.all_of, *r.none_of)}, key=lambda p: (p.text, p.ignore_case))
LINES = sorted({r.line for rules in PACKS.values() for r in rules if hasattr(r.line, "text")},
               key=lambda p: (p.text, p.ignore_case))


def plain(pattern):
    """The pattern with this dialect's dot and blanks, matched by Python itself."""
    swap = {".": NOT_EOL, r"\s": f"[{SPACES}]", r"\S": f"[^{SPACES}]"}
    text = "".join(swap.get(t, t.replace(r"\s", SPACES) if t.startswith("[") else t)
                   for t in tokens(pattern.text))
    return re.compile(text, re.A | (re.I if pattern.ignore_case else 0))


def js_search(pattern, text):
    # Python folds two more characters onto ASCII letters than the dialect does.
    if pattern.ignore_case:
        text = text.replace("\u0130", " ").replace("\u0131", " ").replace("\u212a", " ") \
            .replace("\u017f", " ")
    return plain(pattern).search(text)


def fragments():
    """Pieces of the patterns themselves, so that random texts come close to matching."""
    words = {w for p in ALL for w in re.findall(r"[A-Za-z_:/.-]{2,}", p.text.replace("\\", ""))}
    glue = ["\n", "\r", " ", ".", "(", ")", "'", '"', "`", "+", "${", "}", "=", ":", "//", "*",
            "@", "x", "\u2028", "\u0085", "\u00a0", "\u212a", "\u0130", "Z9", "\x0b", ";"]
    return st.lists(st.one_of(st.sampled_from(sorted(words)), st.sampled_from(glue),
                              st.sampled_from([w.upper() for w in sorted(words)])),
                    max_size=14).map("".join)


@settings(max_examples=5, deadline=None, phases=[Phase.generate], derandomize=True)
@given(st.lists(fragments(), min_size=60, max_size=60))
def test_matches_means_the_same(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string") \
        .selectExpr("i", f"{without_nel('content')} AS t") \
        .selectExpr("i", "t", f"{ascii_lower('t')} AS l")
    tests = [f"{Text('t', 'l').matches(p)} AS p{k}" for k, p in enumerate(ALL)]
    tests += [f"{Text('t', 'l').first_line(p)} AS q{k}" for k, p in enumerate(LINES)]
    for row in df.selectExpr("i", *tests).collect():
        text = texts[row["i"]]
        for k, p in enumerate(ALL):
            assert row[f"p{k}"] == bool(js_search(p, text)), (p, text)
        for k, p in enumerate(LINES):
            at = [n for n, line in enumerate(text.split("\n"), 1) if js_search(p, line)]
            assert row[f"q{k}"] == (at[0] if at else None), (p, text)


def test_plans_use_words_where_they_can():
    from warpsift.rules.base import Pattern, ci
    assert plan(Pattern("express|server")) == (("express", "server"), ())
    assert plan(ci("rate[-_]?LIMIT"))[0] == ("ratelimit", "rate-limit", "rate_limit")
    assert branches("(?:a|b(c|d))|e") == ["a", "b(c|d)", "e"]
    assert same_line_parts(r"a.*?b\.*c.*(d.*e)") == ["a", r"b\.*c", "(d.*e)"]


def test_long_lines_stay_linear(spark):
    """A megabyte on one line with many half matches must not take minutes."""
    import time
    text = 'query("' * 60_000 + "limit " * 60_000 + "+"
    df = spark.createDataFrame([(text,)], "t string").selectExpr("t", "lower(t) AS l")
    start = time.time()
    df.selectExpr(*[f"{Text('t', 'l').matches(p)} AS p{k}" for k, p in enumerate(ALL)
                    if len(same_line_parts(p.text)) > 1]).collect()
    assert time.time() - start < 60


def test_words_of_patterns():
    from warpsift.functions.patterns import plan
    from warpsift.rules.base import Pattern, ci

    def words(text, pattern=Pattern):
        fixed, rest = plan(pattern(text))
        return fixed, [needs for needs, _ in rest]

    assert words("abc|a[bc]d") == (("abc", "abd", "acd"), [])
    assert words("Foo(?:bar|baz)?", ci) == (("foo", "foobar", "foobaz"), [])
    assert words(r"foo\s*\(bar|baz+q") == ((), [(("foo",), ("(bar",)), (("ba",),)])
    assert words(r"x{2,}abc\.d[^e]f{2}gh") == ((), [(("abc.d",), ("gh",))])
    assert words(r"(?:one|two)\d+(?!three)four") == ((), [(("one", "two"), ("four",))])
    assert words(r"(?:a\d|b\d\dcc)dd") == ((), [(("dd",),)])
    assert words(r"\n\t[a-z]{3}[\]x]y") == ((), [(("\n\t",),)])
