"""SQL twins of the named queries, for an independent engine (DuckDB).

The twins share the rule catalog and the file slots with the Spark side, as data, but
none of its method: every pattern is matched as a plain regular expression on every
selected text, lines are found by testing each line, and texts are cut with list
functions instead of marks.
"""

from __future__ import annotations

from ..functions.globs import any_glob
from ..functions.patterns import JS_TRIM, tokens
from ..operators import fixes
from ..operators.reports import RECOMMENDATIONS
from ..operators.routes import CALL, token
from ..operators.select import ROUTE_SKIP, SELECTORS
from ..rules import env as env_rules, iac as iac_rules
from ..rules.base import PER_FILE, PER_MATCH, SEVERITIES, Pattern, Rule
from ..rules.catalog import (ADVISORY_SEVERITY, COMPLIANCE, DASHBOARD_PACKS, FILE_PACKS,
                             FIXER_PACKS, FRAMEWORKS, JSON_REPORT_PACKS, PACK_ORDER, PACKS,
                             REQUIRED_FILES, UNMAINTAINED, deps)
from ..rules.matrix import THREAT_ROWS
from ..rules.prompts import COMMENT_PREFIX, COMMENTS, MATCH_CHARS
from ..schema import FINDING_COLUMNS
from ..sources.corpus import AS_OF, NAMED, OPS, PHRASES, RANGE_FORMS
from ..sources.slots import ENV_SLOT, NO_ENV_PATH, SAMPLE_PATH, SAMPLE_SLOT, SLOTS
from ..streaming.watch import IGNORED
from .late import LATE_RULES

NL = "chr(10)"
_SPACES = (r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
           r"\x{3000}\x{feff}")


def q(text) -> str:
    if text is None:
        return "NULL"
    if isinstance(text, (int, bool)):
        return str(text).lower()
    return "'" + text.replace("'", "''") + "'"


def re2(text: str) -> str:
    out = []
    for t in tokens(text):
        if t == ".":
            out.append(r"[^\n\r\x{2028}\x{2029}]")
        elif t == r"\s":
            out.append(f"[{_SPACES}]")
        elif t == r"\S":
            out.append(f"[^{_SPACES}]")
        elif t == r"[\s\S]":
            out.append("(?s:.)")
        elif t.startswith("["):
            out.append(t.replace(r"\s", _SPACES))
        else:
            out.append(t)
    return "".join(out)


def rx(pattern: Pattern) -> str:
    return q(("(?i)" if pattern.ignore_case else "") + re2(pattern.text))


def test(pattern: Pattern, text="content") -> str:
    if "(?!" in pattern.text:  # no look-ahead in this engine: count instead
        head, tail = pattern.text[:-1].split("(?!")
        return (f"len(regexp_extract_all({text}, {q(re2(head))})) > "
                f"len(regexp_extract_all({text}, {q(re2(f'{head}({tail})'))}))")
    return f"regexp_matches({text}, {rx(pattern)})"


def first_line(rule: Rule) -> str:
    if not isinstance(rule.line, Pattern):
        return q(rule.line)
    return (f"nullif(list_position(list_transform(string_split(content, {NL}), "
            f"lambda l: {test(rule.line, 'l')}), true), 0)")


def selected(selector: str) -> str:
    either = []
    for globs, ignored in SELECTORS[selector]:
        t = f"regexp_matches(path, {q(any_glob(globs))})"
        if ignored:
            t += f" AND NOT regexp_matches(path, {q(any_glob(ignored, dot=True))})"
        either.append(f"({t})")
    tests = ["(" + " OR ".join(either) + ")"]
    if selector == "routes":
        tests += [f"NOT contains(path, {q(s)})" for s in ROUTE_SKIP]
    if selector == "env":
        tests.append("NOT starts_with(path, '.env')")
    return "(" + " AND ".join(tests) + ")"


# ---- corpus -------------------------------------------------------------------------

_SLOT_ROWS = ", ".join(f"({i}, {q(p)}, {q(s)}, {q(c)}, {q(more)})"
                       for i, (p, s, c, more) in enumerate(SLOTS))


def _slot_path(k, repo):
    return (f"CASE WHEN {k} = {SAMPLE_SLOT} AND {repo} % 5 = 0 THEN {q(SAMPLE_PATH)} "
            f"WHEN {k} = {ENV_SLOT} AND {repo} % 4 = 0 THEN {q(NO_ENV_PATH)} ELSE s.path END")


_COMMENTED = f"{NL} || '# ' || replace(text, {NL}, {NL} || '# ')"
_DOCS = "(SELECT count(*) FROM documents)"


CTE: dict[str, str] = {
    "slots": f"SELECT * FROM (VALUES {_SLOT_ROWS}) v(k, path, dirty, clean, form)",
    "files": f"""SELECT doc_id, repo_id, path, '/corpus/r' || repo_id || '/' || path AS abs_path,
        CASE form WHEN 'comment' THEN base || {_COMMENTED}
        WHEN 'env' THEN base || {NL} || 'KEY_' || repo_id % 97 || '=' || doc_id || {_COMMENTED}
        WHEN 'json' THEN rtrim(replace(base, '"dependencies":{{', '"dependencies":{{"lib-' ||
            repo_id % 997 || '":"' || (1 + doc_id % 5) || '.' || doc_id % 10 || '.0",')[:-2]) ||
            ',"about":"' || regexp_replace(text, '["\\\x00-\x1f]', ' ', 'g') || '"}}'
        ELSE base || {NL} || text END AS content
        FROM (SELECT d.doc_id, d.doc_id // 24 AS repo_id, coalesce(d.text, '') AS text, s.form,
                {_slot_path('s.k', '(d.doc_id // 24)')} AS path,
                CASE WHEN (d.doc_id // 24) % 3 <> 0 THEN s.dirty ELSE s.clean END AS base
              FROM documents d JOIN slots s ON d.doc_id % 24 = s.k)""",
    "later_files": """SELECT repo_id, CASE WHEN doc_id % 7 = 4 THEN 'moved/' || path ELSE path END
            AS path, '/corpus/r' || repo_id || '/' || CASE WHEN doc_id % 7 = 4 THEN 'moved/' || path
            ELSE path END AS abs_path,
        CASE WHEN doc_id % 7 = 2 THEN 'const ok = 1;' ELSE content END AS content
        FROM files WHERE doc_id % 14 <> 1""",
    "page_files": """SELECT CAST(1 AS BIGINT) AS repo_id, 'pages/p' || page_id || '.js' AS path,
        '/corpus/pages/pages/p' || page_id || '.js' AS abs_path,
        concat_ws(chr(10), url, html) AS content FROM pages""",
    "talk_files": f"""SELECT CAST(2 AS BIGINT) AS repo_id,
        'prompts/c' || conv_id || '/t' || turn || '.md' AS path,
        '/corpus/talk/prompts/c' || conv_id || '/t' || turn || '.md' AS abs_path,
        ([{', '.join(map(q, PHRASES))}])[conv_id % {len(PHRASES)} + 1] || {NL} || text AS content
        FROM conversations""",
    "file_repos": "SELECT DISTINCT repo_id FROM files",
    "repos": "SELECT repo_id FROM files UNION SELECT repo_id FROM raw_manifest",
    "raw_manifest": f"""SELECT l_orderkey AS repo_id, l_linenumber || '.' ||
        CAST(trunc(l_quantity) AS INT) % 10 || '.' || l_suppkey % 5 AS version,
        CASE WHEN l_partkey BETWEEN 1 AND {len(NAMED)}
             THEN ([{', '.join(map(q, NAMED))}])[l_partkey] ELSE 'pkg-' || l_partkey END AS package
        FROM lineitem""",
    "manifest": """SELECT repo_id, package, arg_max(version,
        list_transform(string_split(version, '.'), lambda x: CAST(x AS INT))) AS version
        FROM raw_manifest GROUP BY ALL""",
    "parts": f"""SELECT *, CASE WHEN p_partkey BETWEEN 1 AND {len(NAMED)}
             THEN ([{', '.join(map(q, NAMED))}])[p_partkey] ELSE 'pkg-' || p_partkey END AS package
        FROM part""",
    "registry": f"""SELECT package, TIMESTAMP '{AS_OF}' - to_days(CAST(p_partkey % 400 AS INT))
        - INTERVAL 1 HOUR AS created FROM parts WHERE p_partkey % 10 <> 0""",
    "advisories": """SELECT package, (['critical','high','moderate','low','info'])[p_size % 5 + 1]
        AS severity, (1 + p_size % 3) || '.0.0' AS introduced, (2 + p_size % 3) || '.5.0' AS fixed,
        CASE WHEN p_size % 2 = 0 THEN 'CVE-2024-' || (10000 + p_partkey) END AS cve,
        CASE WHEN p_size % 3 > 0 THEN 'advisory ' || p_partkey END AS advisory
        FROM parts WHERE p_partkey % 7 = 3""",
    "latest": "SELECT package, (3 + p_size % 6) || '.0.0' AS latest FROM parts",
    "changed": """SELECT repo_id, path, (['A','C','M','D','R'])[doc_id % 5 + 1] AS status
        FROM files""",
    "changes": f"""SELECT e.ts, (e.user_id % {_DOCS}) // 24 AS repo_id,
        {_slot_path('s.k', f'((e.user_id % {_DOCS}) // 24)')} AS path,
        CASE event_type {' '.join(f"WHEN '{e}' THEN '{o}'" for e, o in OPS.items())} END AS op
        FROM events e JOIN slots s ON (e.user_id % {_DOCS}) % 24 = s.k""",
    "due": f"""SELECT DISTINCT strftime(date_trunc('day', ts), '%Y-%m-%d') AS tick, repo_id, path
        FROM changes WHERE op IN ('add', 'change')
        AND NOT regexp_matches(path, {q(IGNORED)})""",
    "compliance": "SELECT * FROM (VALUES " + ", ".join(
        f"({q(o)}, {q(m)}, {q(n)})" for o, m, n in COMPLIANCE) + ") v(owasp, mitre, nist)",
}


# ---- hits ---------------------------------------------------------------------------

_NO = {(r.pack, r.rule_id): i for i, r in
       enumerate(r for rules in PACKS.values() for r in rules)}
CTE["rules"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({_NO[r.pack, r.rule_id]}, {q(r.pack)}, {PACK_ORDER[r.pack]}, {n}, {q(r.rule_id)}, "
    f"{q(r.type)}, {q(r.category)}, {q(r.severity)}, {q(r.title)}, {q(r.env_var)}, "
    f"{q(r.remediation)}, {q(r.best_practice)}, {q(r.owasp_ref)})"
    for rules in PACKS.values() for n, r in enumerate(rules)) + (
    ") v(rule_no, pack, pack_ord, rule_ord, rule_id, type, category, severity, title, "
    "suggested_env_var, remediation, best_practice, owasp)")


def _condition(r: Rule) -> str:
    tests = [test(p, "abs_path") for p in r.path_all]
    tests += ["NOT " + test(p, "abs_path") for p in r.path_none]
    if r.longer_than is not None:
        tests.append(f"length(content) > {r.longer_than}")
    tests += [f"({test(p)})" for p in r.all_of] + [f"NOT ({test(p)})" for p in r.none_of]
    return " AND ".join(tests)


def _row(no, line, match_ord="0", matched="NULL") -> str:
    return (f"SELECT repo_id, path, {no} AS rule_no, CAST({line} AS BIGINT) AS line, "
            f"CAST({match_ord} AS BIGINT) AS match_ord, CAST({matched} AS VARCHAR) "
            "AS matched_text")


def _per_match(r: Rule, no: int, source: str) -> str:
    return f"""{_row(no, 'i', 'row_number() OVER (PARTITION BY repo_id, path ORDER BY i, j) - 1',
                     f'ms[j][1:{r.match_chars}]' if r.match_chars else 'ms[j]')}
        FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j
              FROM (SELECT *, regexp_extract_all(ls[i], {rx(r.all_of[0])}) AS ms
                    FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i
                          FROM (SELECT *, string_split(content, {NL}) AS ls FROM {source}))))"""


def _comments(source: str) -> str:
    forms = []
    for n, p in enumerate(COMMENTS):
        forms.append(f"""SELECT repo_id, path, {n} AS form, j,
            len(string_split(array_to_string(segs[1:j], '') ||
                             coalesce(array_to_string(ms[1:j-1], ''), ''), {NL})) AS line,
            CASE WHEN gs[j] = '' THEN ms[j] ELSE gs[j] END AS words
            FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM (
                SELECT repo_id, path, string_split_regex(content, {rx(p)}) AS segs,
                       regexp_extract_all(content, {rx(p)}) AS ms,
                       regexp_extract_all(content, {rx(p)}, 1) AS gs FROM {source}))""")
    return ("SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY form, j) - 1 AS k "
            f"FROM ({' UNION ALL '.join(forms)})")


_RE2_HEAD = r"(?:[A-Za-z_$][\w$]*\s*)?" + CALL
_RE2_TOKEN = token(_RE2_HEAD, r"\breq\.user\b")


def _route_hits(source: str, no: int) -> str:
    """Depths by running sums; the call a token belongs to is the last one open around it."""
    skip = "t[1] IN (chr(34), chr(39), chr(96), '/')"
    return f"""WITH toks AS (SELECT repo_id, path, i, ts[i] AS t FROM (
            SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT repo_id, path,
                regexp_extract_all(content, {q(_RE2_TOKEN)}) AS ts FROM {source}))),
        kinds AS (SELECT *, length(t) - length(replace(t, {NL}, '')) AS nl,
            CASE WHEN {skip} OR t = {NL} THEN '' WHEN ends_with(t, '=>') OR (ends_with(t, ')')
                AND t[1] NOT IN (')', ',')) THEN 'head' WHEN t[1] = '.' THEN 'write'
            WHEN t IN ('(', '[', '{{') THEN 'open' WHEN t[1] IN (')', ']', '}}')
                OR (t[1] = ',' AND length(t) > 1) THEN 'close'
            WHEN t[1] = 'r' THEN 'user' WHEN t = ',' THEN 'comma' ELSE '' END AS kind FROM toks),
        depths AS (SELECT *, sum(CASE WHEN kind IN ('head', 'write', 'open') THEN 1
                WHEN kind = 'close' THEN -1 ELSE 0 END) OVER w AS after,
            1 + sum(nl) OVER w - nl AS line
            FROM kinds WINDOW w AS (PARTITION BY repo_id, path ORDER BY i)),
        heads AS (SELECT repo_id, path, i, line, after - 1 AS at, row_number() OVER (
            PARTITION BY repo_id, path ORDER BY i) - 1 AS k FROM depths WHERE kind = 'head'),
        ends AS (SELECT h.repo_id, h.path, h.i, min(d.i) AS last FROM heads h JOIN depths d
            ON d.repo_id = h.repo_id AND d.path = h.path AND d.i > h.i AND d.after <= h.at
            GROUP BY ALL),
        spans AS (SELECT h.*, coalesce(last, 1000000000) AS last FROM heads h
            LEFT JOIN ends USING (repo_id, path, i)),
        owned AS (SELECT d.repo_id, d.path, d.i, d.kind, d.after, max(s.i) AS head FROM depths d
            JOIN spans s ON d.repo_id = s.repo_id AND d.path = s.path AND s.i < d.i
                AND d.i < s.last WHERE d.kind IN ('write', 'user', 'comma') GROUP BY ALL),
        judged AS (SELECT s.repo_id, s.path, s.line, s.k, bool_or(kind = 'write') AS writes,
            bool_or(kind = 'user' OR (kind = 'comma' AND o.after = s.at + 1)) AS guarded
            FROM spans s JOIN owned o ON o.repo_id = s.repo_id AND o.path = s.path
                AND o.head = s.i GROUP BY ALL)
        {_row(no, 'line', 'k')} FROM judged WHERE writes AND NOT guarded"""


# The top-level key with its value behind it, on the next line, or in a map on one line.
_VALUE = r"""["']?write-all["']?"""
_TOP_KEY = r"""["']?permissions["']?[ \t]*:"""
_WRITE_ALL = (rf"(?:^|\n){_TOP_KEY}[ \t]+(?:[&!]\S+[ \t]+)*{_VALUE}[ \t\r]*(?:[ \t]#[^\n]*)?(?:\n|$)"
              rf"|(?:^|\n){_TOP_KEY}[ \t\r]*(?:#[^\n]*)?(?:\n[ \t\r]*(?:#[^\n]*)?)*\n[ \t]+{_VALUE}"
              rf"[ \t\r]*(?:[ \t]#[^\n]*)?(?:\n|$)"
              rf"|(?:^|\n)\{{(?:[^{{}}\n]*,)?[ \t]*{_TOP_KEY}[ \t]+{_VALUE}[ \t]*[,}}]")


def hits(pack: str, source: str = "files", everything: bool = False) -> str:
    """All rows (repo_id, path, rule_no, line, match_ord, matched_text) of one pack."""
    rows = []

    def where(selector):
        return f"(SELECT * FROM {source} WHERE {'true' if everything else selected(selector)})"

    no = {r.rule_id: _NO[pack, r.rule_id] for r in PACKS[pack]}
    for r in PACKS[pack]:
        if r.emits == PER_FILE:
            rows.append(f"{_row(no[r.rule_id], first_line(r))} FROM {where(pack)} "
                        f"WHERE {_condition(r)}")
        elif r.emits == PER_MATCH:
            rows.append(_per_match(r, no[r.rule_id], where(pack)))
    if pack == "prompts":
        for r in PACKS[pack]:
            if r.emits == COMMENT_PREFIX:
                rows.append(f"{_row(no[r.rule_id], 'line', 'k', f'words[1:{MATCH_CHARS}]')} "
                            f"FROM ({_comments(where('comments'))}) "
                            f"WHERE {test(r.all_of[0], 'words')}")
    if pack == "routes":
        rows.append(_route_hits(where("routes"), no["route_no_auth"]))
    if pack == "iac":
        lines = (f"(SELECT repo_id, path, i, trim(ls[i], {q(JS_TRIM)}) AS t FROM (SELECT *, "
                 f"unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, "
                 f"string_split(content, {NL}) AS ls FROM {where('dockerfiles')})))")
        is_user = "starts_with(upper(t), 'USER ')"
        is_root = "(string_split(t, ' '))[2] IN ('root', '0')"
        order = "row_number() OVER (PARTITION BY repo_id, path ORDER BY i) - 1"
        rows.append(f"{_row(no['docker_root'], 'i', order)} FROM {lines} "
                    f"WHERE {is_user} AND {is_root}")
        rows.append(f"{_row(no['curl_bash'], 'i', order)} FROM {lines} "
                    "WHERE contains(t, 'curl ') AND contains(t, '| bash')")
        rows.append(f"{_row(no['docker_implicit'], '1')} FROM {lines} GROUP BY repo_id, path "
                    f"HAVING NOT bool_or({is_user} AND NOT {is_root})")
        at = (f"coalesce(list_position(list_transform(string_split(content, {NL}), lambda l: "
              f"contains(l, {q(iac_rules.WRITE_ALL_TEXT)})), true), 1)")
        rows.append(f"{_row(no['gha_write_all'], at)} FROM {where('workflows')} "
                    f"WHERE regexp_matches(content, {q(_WRITE_ALL)})")
    return " UNION ALL ".join(f"({r})" for r in rows)


def rule_findings(rules, source="files") -> str:
    """Finding rows of given rules, each as a plain expression over its selected files."""
    rows = []
    for n, r in enumerate(rules):
        where = f"(SELECT * FROM {source} WHERE {selected(r.pack)})"
        rows.append(_per_match(r, n, where) if r.emits == PER_MATCH else
                    f"{_row(n, first_line(r))} FROM {where} WHERE {_condition(r)}")
    values = ", ".join(
        "(" + ", ".join(map(q, (n, r.pack, r.rule_id, r.type, r.category, r.severity, r.title,
                                r.env_var, r.remediation, r.best_practice, r.owasp_ref))) + ")"
        for n, r in enumerate(rules))
    columns = [c for c in FINDING_COLUMNS if c not in ("finding_id", "package", "best_practice")]
    return (f"SELECT {', '.join(columns)}, CAST(best_practice AS VARCHAR) AS best_practice, "
            f"{_KEYED} AS finding_id, CAST(NULL AS VARCHAR) AS package "
            f"FROM ({' UNION ALL '.join(f'({r})' for r in rows)}) JOIN (VALUES {values}) "
            "v(rule_no, pack, rule_id, type, category, severity, title, suggested_env_var, "
            "remediation, best_practice, owasp) USING (rule_no)")


_KEYED = ("sha256(concat_ws('|', repo_id, path, rule_id, match_ord))")
_ORDERS = ["pack_ord", "rule_ord"]


def findings(packs, source="files", everything=False) -> str:
    """Finding rows of file packs, as a query."""
    union = " UNION ALL ".join(hits(p, source, everything) for p in packs)
    columns = [c for c in FINDING_COLUMNS if c not in ("finding_id", "package")]
    found = (f"SELECT {', '.join(columns)}, {_KEYED} AS finding_id, "
             f"CAST(NULL AS VARCHAR) AS package, pack_ord, rule_ord "
             f"FROM ({union}) JOIN rules USING (rule_no)")
    parts = [f"SELECT {', '.join(FINDING_COLUMNS + _ORDERS)} FROM ({found})"]
    if "env" in packs and not everything:
        parts.append(_env_repo())
    return " UNION ALL ".join(parts)


# ---- environment files --------------------------------------------------------------

_TRIMMED = f"trim(ls[i], {q(JS_TRIM)})"
CTE["env_lines"] = f"""SELECT repo_id, CAST(i AS BIGINT) AS line, {_TRIMMED} AS text
    FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT repo_id,
          string_split(content, {NL}) AS ls FROM files WHERE path = '.env'))"""
CTE["env_issues"] = " UNION ALL ".join(
    f"SELECT repo_id, line, {q(issue)} AS issue, {suggestion} AS suggestion FROM env_lines "
    f"WHERE text <> '' AND NOT starts_with(text, '#') AND {cond}"
    for issue, cond, suggestion in (
        (env_rules.ISSUE_KEY, "NOT " + test(Pattern(env_rules.KEY_FORM), "text"), "text"),
        (env_rules.ISSUE_SPACES, test(Pattern(env_rules.SPACED), "text"),
         rf"regexp_replace(text, '\s*=\s*', '=')"),
        (env_rules.ISSUE_QUOTES, test(Pattern(env_rules.UNQUOTED), "text") + " AND NOT "
         + test(Pattern(env_rules.QUOTED), "text"), r"""regexp_replace(text, '=(.*)', '="\1"')""")))
CTE["env_facts"] = f"""SELECT repo_id, bool_or(path = '.env') AS has_env,
    bool_or(path = '.gitignore' AND contains(content, '.env')) AS ignored,
    bool_or(path = '.env.example') AS sample FROM files GROUP BY repo_id"""


def _env_repo() -> str:
    content_hits = hits("env")
    cases = (("gitignore_missing", "NOT ignored", ".gitignore"),
             ("no_env_example", "NOT sample", ".env.example"),
             ("env_missing", "NOT has_env AND n_hits > 0", ".env"),
             ("env_format", "n_issues > 0", ".env"))
    rows = " UNION ALL ".join(
        f"SELECT repo_id, {q(path)} AS path, {_NO['env', rule]} AS rule_no, n_issues "
        f"FROM env_counts WHERE {cond}" for rule, cond, path in cases)
    columns = {c: c for c in FINDING_COLUMNS + _ORDERS}
    columns |= {"line": "CAST(NULL AS BIGINT)", "match_ord": "CAST(0 AS BIGINT)",
                "matched_text": "CAST(NULL AS VARCHAR)", "package": "CAST(NULL AS VARCHAR)",
                "finding_id": "sha256(concat_ws('|', repo_id, path, rule_id, 0))",
                "title": "CASE WHEN rule_id = 'env_format' THEN n_issues || "
                         "' formatting issue(s) in the environment file' ELSE title END"}
    return f"""SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())}
        FROM (WITH env_counts AS (SELECT f.*, coalesce(h.n, 0) AS n_hits,
                coalesce(i.n, 0) AS n_issues FROM env_facts f
                LEFT JOIN (SELECT repo_id, count(*) AS n FROM ({content_hits}) GROUP BY 1) h
                USING (repo_id)
                LEFT JOIN (SELECT repo_id, count(*) AS n FROM env_issues GROUP BY 1) i
                USING (repo_id)) {rows}) JOIN rules USING (rule_no)"""


# ---- dependencies -------------------------------------------------------------------

def _numbers(v):
    return f"list_transform(string_split({v}, '.'), lambda x: CAST(x AS INT))"


def _dep(rule_id, source, title, severity=None, remediation=None, key=None) -> str:
    n, r = next((i, r) for i, r in enumerate(deps.rules) if r.rule_id == rule_id)
    ids = "'|', repo_id, 'package.json', " + q(rule_id) + ", package" + (f", {key}" if key else "")
    values = dict(
        pack="'deps'", rule_id=q(rule_id), finding_id=f"sha256(concat_ws({ids}))", type=q(r.type),
        category=q(r.category), severity=severity or q(r.severity), title=title,
        repo_id="repo_id", path="'package.json'", line="CAST(NULL AS BIGINT)",
        match_ord="CAST(0 AS BIGINT)", matched_text="CAST(NULL AS VARCHAR)",
        suggested_env_var="CAST(NULL AS VARCHAR)", remediation=remediation or q(r.remediation),
        best_practice=f"CAST({q(r.best_practice)} AS VARCHAR)",
        owasp=f"CAST({q(r.owasp_ref)} AS VARCHAR)", package="package",
        pack_ord=PACK_ORDER["deps"], rule_ord=n)
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in values.items())} FROM ({source})"


def _title(rule_id):
    return q(next(r.title for r in deps.rules if r.rule_id == rule_id))


_LEVELS = "CASE level " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in
                                   ADVISORY_SEVERITY.items()) + " ELSE 'medium' END"
DEPS = {
    "known_vulnerabilities": _dep(
        "known_cve", f"""SELECT m.*, a.severity AS level, a.introduced, a.fixed FROM manifest m
            JOIN advisories a USING (package)
            WHERE {_numbers('a.introduced')} <= {_numbers('m.version')}
            AND {_numbers('m.version')} < {_numbers('a.fixed')}""",
        f"{_title('known_cve')} || package || '@' || version", severity=_LEVELS,
        key="introduced || '-' || fixed",
        remediation="'Move to version ' || fixed || ' or later.'"),
    "outdated_major": _dep(
        "outdated_major", """SELECT * FROM (SELECT m.*, CAST(split_part(latest, '.', 1) AS INT)
            - CAST(split_part(version, '.', 1) AS INT) AS gap
            FROM manifest m JOIN latest USING (package)) WHERE gap > 0""",
        f"{_title('outdated_major')} || package || ' by ' || gap || ' major version(s)'",
        severity="CASE WHEN gap > 1 THEN 'medium' ELSE 'low' END"),
    "unmaintained": _dep(
        "unmaintained", "SELECT * FROM manifest JOIN (VALUES " + ", ".join(
            f"({q(p)}, {q(a)})" for p, a in UNMAINTAINED) + ") u(package, advice) USING (package)",
        f"{_title('unmaintained')} || package", remediation="advice"),
    "hallucinated_package": _dep(
        "hallucinated", """SELECT * FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM registry r
            WHERE r.package = m.package) AND NOT starts_with(package, 'file:')
            AND NOT starts_with(package, 'git+') AND NOT starts_with(package, 'github:')""",
        f"{_title('hallucinated')} || package"),
    "brand_new_package": _dep(
        "brand_new", f"""SELECT * FROM (SELECT m.*, (epoch(TIMESTAMP '{AS_OF}')
            - epoch(created)) / 86400.0 AS age FROM manifest m JOIN registry USING (package))
            WHERE age < 7""",
        f"{_title('brand_new')} || package || ' (' || CAST(round(age) AS INT) || ' days)'"),
}
CTE["dep_findings"] = " UNION ALL ".join(DEPS.values())


# ---- queries ------------------------------------------------------------------------

_COLS = ", ".join(FINDING_COLUMNS)


def _list(packs):
    return "(" + ", ".join(q(p) for p in packs) + ")"


def _sum(cond):
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


def _sev(name):
    return _sum(f"severity = '{name}'") + f" AS {name}"


_N = "CAST(count(*) AS BIGINT)"
_EACH = ", ".join(_sev(s) for s in SEVERITIES)


def _per_repo(repos, aggregates, select, source="found"):
    return (f"SELECT repo_id, {select} FROM {repos} LEFT JOIN (SELECT repo_id, {aggregates} "
            f"FROM {source} GROUP BY repo_id) USING (repo_id)")


def _z(name):
    return f"coalesce({name}, 0) AS {name}"


_GRADE = ("CASE WHEN coalesce(total, 0) = 0 THEN 'A+' WHEN total < 5 THEN 'A' "
          "WHEN total < 15 THEN 'B' WHEN total < 30 THEN 'C' ELSE 'F' END AS grade")
_ORDER = "pack_ord, repo_id, path, rule_ord, match_ord"
_FULL = (FILE_PACKS, True)


def _fixing() -> str:
    markup = [_NO[r.pack, r.rule_id] for p in FIXER_PACKS for r in PACKS[p]
              if r.category == "xss-risk"]
    marker = q(fixes.MARKER)
    secret = "regexp_replace(acc, '[''\"`][^''\"`]+[''\"`]', 'process.env.' || x)"
    markup_fix = "regexp_replace(acc, 'innerHTML', 'textContent')"
    new = (f"CASE WHEN x = '#' THEN {markup_fix} WHEN contains(acc, '=') THEN {secret} "
           "ELSE acc END")
    return f"""SELECT repo_id, path, string_agg(text, {NL} ORDER BY i) AS content,
            CAST(sum((length(text) - length(replace(text, {marker}, ''))) //
                {len(fixes.MARKER)}) AS BIGINT) AS fixes
        FROM (SELECT repo_id, path, i, CASE WHEN acts IS NULL THEN l ELSE list_reduce(acts,
                lambda acc, x: CASE WHEN {new} <> acc THEN {new} || {marker} ELSE acc END, l)
                END AS text
              FROM (SELECT repo_id, path, i, ls[i] AS l FROM (SELECT repo_id, path,
                    string_split(content, {NL}) AS ls,
                    unnest(range(1, len(string_split(content, {NL})) + 1)) AS i FROM files))
              LEFT JOIN (SELECT repo_id, path, line AS i,
                    list(coalesce(suggested_env_var, '#') ORDER BY pack_ord, rule_ord, match_ord)
                    AS acts FROM found JOIN rules USING (pack, rule_id)
                    WHERE line > 0 AND (found.suggested_env_var IS NOT NULL
                    OR rules.rule_no IN {tuple(markup)}) GROUP BY ALL) USING (repo_id, path, i))
        GROUP BY repo_id, path HAVING fixes > 0""".replace(
        "coalesce(suggested_env_var", "coalesce(found.suggested_env_var").replace(
        "ORDER BY pack_ord, rule_ord, match_ord", "ORDER BY found.pack_ord, found.rule_ord, "
        "match_ord")


def _ranges() -> str:
    """Declared ranges and advisories compared pair by pair. The spans of each form are stated
    here, none is read from its text. A point is [major, minor, patch, kind, number]; the kinds
    are 0 below all pre-releases, 1 pre-release, 2 release, 3 behind the release."""
    lo, major, minor = "[a, b, c, 2, 0]", "[a + 1, 0, 0, 0, 0]", "[a, b + 1, 0, 0, 0]"
    exact = "[a, b, c, 3, 0]"
    spans = ([(lo, exact)], [(lo, major)], [(lo, minor)], [("[a, 0, 0, 2, 0]", major)],
             [("[a, b, 0, 2, 0]", minor)], [(lo, "[a + 1, 5, 0, 0, 0]")],
             [(lo, "[a + 1, 3, 0, 0, 0]")],
             [(lo, major), ("[a + 2, b, c, 2, 0]", "[a + 2, b, c, 3, 0]")],
             [("[a, b, c, 1, c]", "[a, b, c, 1, c + 1]")], [])
    listed = " ".join(f"WHEN {n} THEN [" + ", ".join(
        f"{{'lo': {x}, 'hi': {y}}}" for x, y in form) + "]" for n, form in enumerate(spans) if form)
    texts = " ".join(
        f"WHEN {n} THEN " + " || ".join(
            {"a1": "(a + 1)", "a2": "(a + 2)"}.get(t, t) if i % 2 else q(t)
            for i, t in enumerate(form.replace("}", "{").split("{")) if i % 2 or t)
        for n, form in enumerate(RANGE_FORMS))
    return f"""SELECT DISTINCT repo_id, package, version, {_LEVELS} AS severity, introduced, fixed,
            CASE WHEN len(list_filter(spans, lambda s: s.lo >= lo AND s.hi <= hi)) = len(spans)
                THEN 'all' ELSE 'some' END AS exposure,
            'Move to version ' || fixed || ' or later.' AS remediation
        FROM (SELECT repo_id, package, CASE form {texts} END AS version,
                CASE form {listed} END AS spans
              FROM (SELECT l_orderkey AS repo_id, l_linenumber::BIGINT AS a,
                      CAST(trunc(l_quantity) AS INT) % 10 AS b, l_suppkey % 5 AS c,
                      (l_partkey + l_linenumber) % {len(RANGE_FORMS)} AS form,
                      CASE WHEN l_partkey BETWEEN 1 AND {len(NAMED)}
                        THEN ([{', '.join(map(q, NAMED))}])[l_partkey]
                        ELSE 'pkg-' || l_partkey END AS package FROM lineitem))
        JOIN (SELECT package, severity AS level, introduced, fixed,
                [split_part(introduced, '.', 1)::BIGINT, 0, 0, 2, 0] AS lo,
                [split_part(fixed, '.', 1)::BIGINT, 5, 0, 0, 0] AS hi FROM advisories)
        USING (package)
        WHERE len(list_filter(spans, lambda s: s.lo < hi AND lo < s.hi)) > 0"""


def _package(key: str) -> str:
    return (f"CASE WHEN {key} BETWEEN 1 AND {len(NAMED)} THEN ([{', '.join(map(q, NAMED))}])[{key}] "
            f"ELSE 'pkg-' || {key} END")


_INDIRECT = f"""WITH RECURSIVE needs AS (
        SELECT {_package('p_partkey')} AS package, {_package('need')} AS requires,
            (1 + p_partkey % 5) || '.' || p_partkey % 10 || '.0' AS version
        FROM (SELECT p_partkey, unnest([CASE WHEN p_partkey > 1 THEN p_partkey // 2 END,
                CASE WHEN p_partkey % 10 = 0 THEN (3 * p_partkey + 1) % most + 1 END,
                CASE WHEN p_partkey % 11 = 0 AND p_partkey < most THEN p_partkey + 1 END]) AS need
              FROM part, (SELECT max(p_partkey) AS most FROM part)) WHERE need IS NOT NULL),
    affected AS (SELECT requires, version, arg_min({_LEVELS}, CASE {_LEVELS}
            {' '.join(f"WHEN {q(s)} THEN {n}" for n, s in enumerate(SEVERITIES))} END) AS severity
        FROM (SELECT DISTINCT requires, version FROM needs)
        JOIN (SELECT package AS requires, severity AS level, introduced, fixed FROM advisories)
        USING (requires) WHERE {_numbers('introduced')} <= {_numbers('version')}
        AND {_numbers('version')} < {_numbers('fixed')} GROUP BY 1, 2),
    walk(package, target, version, hops, path) USING KEY (package, target, version) AS (
        SELECT package, requires, version, 1, min(package || ' > ' || requires || '@' || version)
        FROM needs SEMI JOIN affected USING (requires, version) GROUP BY 1, 2, 3
        UNION
        SELECT n.package, w.target, w.version, w.hops + 1, min(n.package || ' > ' || w.path)
        FROM walk w JOIN (SELECT DISTINCT package, requires FROM needs) n ON n.requires = w.package
        LEFT JOIN recurring.walk r ON r.package = n.package AND r.target = w.target
            AND r.version = w.version
        WHERE r.package IS NULL GROUP BY 1, 2, 3, 4)
    SELECT repo_id, target AS package, w.version, severity, min(hops)::INTEGER AS hops,
        arg_min(path, (hops, path)) AS reason
    FROM (SELECT DISTINCT repo_id, package FROM raw_manifest) JOIN walk w USING (package)
    JOIN affected a ON a.requires = w.target AND a.version = w.version
    GROUP BY repo_id, target, w.version, severity"""


def _queries() -> dict[str, tuple]:
    """name -> (packs of `found` or None, with dependencies?, SQL)."""
    js = JSON_REPORT_PACKS
    out = {f"pack_{p}": ([p], False, f"SELECT {_COLS} FROM found")
           for p in (*FILE_PACKS, "matrix")}
    for name, sql in DEPS.items():
        out[name] = (None, False, f"SELECT {_COLS} FROM ({sql})")
    out |= {
        "selector_counts_all": (None, False, " UNION ALL ".join(
            f"SELECT {q(s)} AS selector, {_sum(selected(s))} AS files FROM files"
            for s in SELECTORS)),
        "ignore_user_patterns": (["secrets"], False, f"""SELECT {_COLS} FROM found
            WHERE NOT starts_with(path, 'prompts/') AND path <> 'src/config.js'"""),
        "distinct_files": (None, False, f"""SELECT DISTINCT repo_id, path FROM files
            WHERE {selected('owasp')} OR {selected('db')}"""),
        "findings_sink": (js, False, f"SELECT {_COLS} FROM found"),
        "json_report_sink": (js, False, """SELECT finding_id AS id, severity, type, category,
            title, path AS file, line, CAST(NULL AS BIGINT) AS "column", remediation,
            suggested_env_var AS "suggestedEnvVar", owasp AS "owaspReference",
            matched_text AS "matchedPattern" FROM found"""),
        "pages_owasp": (None, False, f"SELECT {_COLS} FROM ({findings(['owasp'], 'page_files')})"),
        "talk_prompts": (None, False,
                         f"SELECT {_COLS} FROM ({findings(['prompts'], 'talk_files')})"),
        "scan_toggles": (["owasp", "headers", "iac"], False,
                         f"SELECT pack, {_N} AS findings FROM found GROUP BY pack"),
        "tree_scan": (["auth"], False, f"SELECT {_COLS} FROM found"),
        "tree_listing": (None, False, """SELECT repo_id, path FROM files
            WHERE starts_with(path, 'src/') AND NOT ends_with(path, '.ts')"""),
        "indirect_vulnerabilities": (None, False, _INDIRECT),
        "range_vulnerabilities": (None, False, _ranges()),
        "vulnerability_details": (None, False, f"""SELECT repo_id, package, version,
            {_LEVELS} AS severity, coalesce(cve, 'N/A') AS cve,
            coalesce(advisory, 'N/A') AS advisory,
            '>=' || introduced || ' <' || fixed AS vulnerable_range,
            '>=' || fixed AS patched_range,
            'Move to version ' || fixed || ' or later.' AS remediation FROM (
            SELECT m.*, a.* EXCLUDE (package, severity), a.severity AS level FROM manifest m
            JOIN advisories a USING (package)
            WHERE {_numbers('a.introduced')} <= {_numbers('m.version')}
            AND {_numbers('m.version')} < {_numbers('a.fixed')})"""),
        "json_report": (js, False, f"""WITH counts AS (SELECT repo_id, {_N} AS total, {_EACH}
            FROM found GROUP BY 1), scans AS (SELECT repo_id, string_agg(pack || ':' || n, ','
            ORDER BY pack) AS scans FROM (SELECT repo_id, pack, count(*) AS n FROM found
            GROUP BY 1, 2) GROUP BY 1), kinds AS (SELECT repo_id, string_agg(type || ':' || n, ','
            ORDER BY type) AS types FROM (SELECT repo_id, type, count(*) AS n FROM found
            GROUP BY 1, 2) GROUP BY 1), advice AS (SELECT repo_id, string_agg(position || '. [' ||
            priority || '] ' || title, '; ' ORDER BY position) AS recommendations
            FROM ({' UNION ALL '.join(
                f"SELECT repo_id, {i} AS position, {q(p)} AS priority, {q(t)} AS title "
                f"FROM file_repos" + (f" WHERE repo_id IN (SELECT repo_id FROM found WHERE {cond})"
                                      if cond else "")
                for i, (cond, p, t, a) in enumerate(RECOMMENDATIONS, start=1))}) GROUP BY 1)
            SELECT repo_id, '{AS_OF}' AS generated, {', '.join(_z(c) for c in
                                                             ('total', *SEVERITIES))},
            CASE WHEN critical > 0 THEN 'fail' WHEN high > 0 THEN 'warning' ELSE 'pass' END
            AS status, coalesce(scans, '') AS scans, coalesce(types, '') AS types,
            recommendations FROM file_repos LEFT JOIN counts USING (repo_id)
            LEFT JOIN scans USING (repo_id) LEFT JOIN kinds USING (repo_id)
            LEFT JOIN advice USING (repo_id)"""),
        "maintained_findings": (None, False,
                                f"SELECT {_COLS} FROM ({findings(js, 'later_files')})"),
        "maintained_grades": (None, False, f"""SELECT repo_id, {_z('total')}, {_GRADE}
            FROM (SELECT DISTINCT repo_id FROM later_files) LEFT JOIN (SELECT repo_id,
            {_N} AS total FROM ({findings(js, 'later_files')}) GROUP BY 1) USING (repo_id)"""),
        "indexed_packs": (("secrets", "owasp", "db", "prompts"), False,
                          f"SELECT {_COLS} FROM found"),
        "late_rules": (None, False, f"SELECT {_COLS} FROM ({rule_findings(LATE_RULES)})"),
        "stored_changed_files": (None, False, f"""SELECT {_COLS} FROM (
            {findings(['secrets'], everything=True)}) JOIN changed USING (repo_id, path)
            WHERE status IN ('A', 'C', 'M')"""),
        "quick_scan": (["secrets"], False, f"SELECT {_COLS} FROM found"),
        "quiet_filter": (FILE_PACKS, False, """SELECT repo_id, path, rule_id, severity, line
            FROM found WHERE severity = 'critical'"""),
        "explain_candidates": (FILE_PACKS, False, """SELECT repo_id, path,
            rule_id, severity, line FROM found WHERE severity IN ('critical', 'high')"""),
        "fixable_filter": (FIXER_PACKS, False,
                           "SELECT repo_id, path, rule_id, line FROM found WHERE line > 0"),
        "merge_dependency_maps": (None, False, """SELECT repo_id, CAST(count(*) AS BIGINT)
            AS packages, string_agg(package || '@' || version, ',' ORDER BY package || '@'
            || version) AS declared FROM declared GROUP BY repo_id"""),
        "manifest_source": (None, False, "SELECT repo_id, package, version FROM declared"),
        "dotenv_source": (None, False, "SELECT repo_id, line, text FROM env_lines"),
        "env_issues": (None, False, "SELECT repo_id, line, issue, suggestion FROM env_issues"),
        "dependency_scan": (None, False, """SELECT repo_id, coalesce(n, 0) AS findings,
            CASE WHEN c THEN 'critical' WHEN h THEN 'high' ELSE 'medium' END AS severity
            FROM repos LEFT JOIN (SELECT repo_id, CAST(count(*) AS BIGINT) AS n,
            bool_or(severity = 'critical') AS c, bool_or(severity = 'high') AS h
            FROM dep_findings GROUP BY 1) USING (repo_id)"""),
        "dependencies_scanned": (None, False, """SELECT repo_id, CAST(count(DISTINCT package)
            AS BIGINT) AS dependencies FROM raw_manifest GROUP BY 1"""),
        "estate_dependencies": (None, False, """SELECT CAST(repo_id % 64 % 8 AS INTEGER) AS share,
            CAST(count(DISTINCT package) AS BIGINT) AS packages,
            CAST(count(DISTINCT (repo_id, package)) AS BIGINT) AS uses,
            CAST(count(*) AS BIGINT) AS declared, true AS packages_near, true AS uses_near,
            true AS declared_equal FROM raw_manifest GROUP BY 1"""),
        "framework_of_repo": (None, False, f"""SELECT repo_id, coalesce(framework, 'unknown')
            AS framework FROM repos LEFT JOIN (SELECT repo_id, arg_min(framework, priority)
            AS framework FROM raw_manifest JOIN (VALUES {', '.join(
                f'({q(p)}, {q(f)}, {n})' for p, f, n in FRAMEWORKS)})
            w(package, framework, priority) USING (package) GROUP BY 1) USING (repo_id)"""),
        "compliance_enrich_findings": (FILE_PACKS, False, """SELECT repo_id, path,
            rule_id, match_ord, owasp, mitre, nist FROM found LEFT JOIN compliance
            USING (owasp)"""),
        "changed_files": (None, False, f"""SELECT {_COLS} FROM (
            {findings(['secrets'], everything=True)}) JOIN changed USING (repo_id, path)
            WHERE status IN ('A', 'C', 'M')"""),
        "fix_lines": (FIXER_PACKS, False, f"""SELECT repo_id, path, line, rule_id,
            match_ord, (string_split(content, {NL}))[line] AS text FROM found
            JOIN files USING (repo_id, path) WHERE line > 0"""),
        "all_findings": (*_FULL, f"SELECT {_COLS} FROM found"),
        "category_summary": (*_FULL, f"""SELECT pack, category, {_N} AS findings FROM found
            GROUP BY pack, category"""),
        "severity_counts": (js, False, f"SELECT {_N} AS total, {_EACH} FROM found"),
        "type_counts": (js, False, f"SELECT type, {_N} AS findings FROM found GROUP BY type"),
        "file_counts": (js, False, f"""SELECT repo_id, path, {_N} AS findings FROM found
            GROUP BY repo_id, path"""),
        "report_rollup": (js, False, f"""SELECT CASE grouping(severity, type, repo_id, path)
            WHEN 15 THEN 'total' WHEN 7 THEN 'severity' WHEN 11 THEN 'type' ELSE 'file' END
            AS level, severity, type, repo_id, path, {_N} AS findings FROM found
            GROUP BY GROUPING SETS ((), (severity), (type), (repo_id, path))"""),
        "overall_status": (js, False, _per_repo("file_repos", f"{_N} AS total, {_EACH}", ", ".join(
            _z(c) for c in ("total", *SEVERITIES)) + """, CASE WHEN critical > 0 THEN 'fail'
            WHEN high > 0 THEN 'warning' ELSE 'pass' END AS status""")),
        "security_grade": (*_FULL, _per_repo("repos", f"{_N} AS total",
                                             f"{_z('total')}, {_GRADE}")),
        "owasp_grade": (["owasp"], False, _per_repo("file_repos", f"{_N} AS total",
                                                    f"{_z('total')}, {_GRADE}")),
        "release_gate": (*_FULL, _per_repo("repos", "bool_or(severity = 'critical') AS b",
                                           "coalesce(b, false) AS blocked")),
        "commit_gate": (None, False, _per_repo(
            "file_repos", f"{_N} AS total, {_sev('critical')}, {_sev('high')}",
            ", ".join(_z(c) for c in ("total", "critical", "high"))
            + ", coalesce(critical + high, 0) > 0 AS blocked",
            f"""(SELECT * FROM ({findings(['secrets'], everything=True)})
                JOIN changed USING (repo_id, path) WHERE status IN ('A', 'C', 'M'))""")),
        "assessment": (js, False, _per_repo(
            "file_repos", f"{_N} AS total, {_sev('critical')}",
            f"""{_z('total')}, CASE WHEN total IS NULL THEN 'excellent' WHEN critical > 0
            THEN 'critical' ELSE 'warning' END AS assessment""")),
        "dashboard_tiles": (*_FULL, f"""SELECT repo_id, {_z('critical')}, {_z('high')},
            coalesce(total - critical - high, 0) AS rest FROM repos LEFT JOIN (
            SELECT repo_id, {_N} AS total, {_sev('critical')}, {_sev('high')} FROM found
            WHERE pack IN {_list(DASHBOARD_PACKS)} GROUP BY 1) USING (repo_id)"""),
        "dashboard_table": (*_FULL, f"""WITH tiles AS (SELECT repo_id, {_N} AS total,
            {_sum(f"pack IN {_list(DASHBOARD_PACKS)}")} AS shown,
            {_sum(f"severity = 'critical' AND pack IN {_list(DASHBOARD_PACKS)}")} AS critical,
            {_sum(f"severity = 'high' AND pack IN {_list(DASHBOARD_PACKS)}")} AS high
            FROM found GROUP BY 1)
            SELECT repo_id, finding_id, severity, title, path, line, category, owasp, mitre, nist,
            remediation, total AS repo_total, {_GRADE}, critical, high,
            shown - critical - high AS rest FROM found LEFT JOIN compliance USING (owasp)
            JOIN tiles USING (repo_id) WHERE pack IN {_list(DASHBOARD_PACKS)}"""),
        "pack_severity": (*_FULL, f"""SELECT pack, CASE WHEN c IS NULL
            THEN 'none' WHEN c THEN 'critical' WHEN h THEN 'high' ELSE 'medium' END AS severity
            FROM (SELECT unnest([{', '.join(q(p) for p in (*FILE_PACKS, 'deps'))}]) AS pack)
            LEFT JOIN (SELECT pack, bool_or(severity = 'critical') AS c,
            bool_or(severity = 'high') AS h FROM found GROUP BY 1) USING (pack)"""),
        "scans_performed": (js, False, f"""SELECT pack,
            coalesce(n, 0) AS findings FROM (SELECT unnest([{', '.join(map(q, js))}]) AS pack)
            LEFT JOIN (SELECT pack, {_N} AS n FROM found GROUP BY 1) USING (pack)"""),
        "prompt_files_scanned": (None, False, f"""SELECT repo_id, {_sum(selected('prompts'))}
            AS prompt_files FROM files GROUP BY 1"""),
        "env_config_status": (None, False, """SELECT repo_id, has_env AS env_exists,
            ignored AS env_in_gitignore, sample AS env_example_exists,
            has_env AS has_validation FROM env_facts"""),
        "env_file_stats": (None, False, f"""SELECT repo_id, total_lines, valid_entries,
            coalesce(issues, 0) AS issues FROM (SELECT repo_id, {_N} AS total_lines,
            {_sum(test(Pattern(env_rules.KEY_FORM), 'text'))} AS valid_entries FROM env_lines
            GROUP BY 1) LEFT JOIN (SELECT repo_id, {_N} AS issues FROM env_issues GROUP BY 1)
            USING (repo_id)"""),
        "required_files_check": (None, False, f"""SELECT r.repo_id, w.path, w.required,
            CASE WHEN f.path IS NOT NULL THEN 'ok' WHEN w.required THEN 'missing'
            ELSE 'optional' END AS status, w.path = '.gitignore' AND f.path IS NOT NULL
            AND NOT contains(f.content, '.env') AS warning FROM file_repos r
            CROSS JOIN (VALUES {', '.join(f'({q(p)}, {q(n)})' for p, n in REQUIRED_FILES)})
            w(path, required) LEFT JOIN files f ON f.repo_id = r.repo_id AND f.path = w.path"""),
        "recommendations": (js, False, " UNION ALL ".join(
            f"SELECT repo_id, CAST({i} AS INTEGER) AS position, {q(p)} AS priority, {q(t)} "
            f"AS title, {q(a)} AS advice FROM file_repos" + (
                f" WHERE repo_id IN (SELECT repo_id FROM found WHERE {cond})" if cond else "")
            for i, (cond, p, t, a) in enumerate(RECOMMENDATIONS, start=1))),
        "threat_coverage": (["matrix"], False, f"""SELECT threat, name, severity, category, owasp,
            CAST(patterns AS INTEGER) AS patterns, coalesce(files, 0) AS files,
            coalesce(repos, 0) AS repos FROM (VALUES {', '.join(
                '(' + ', '.join(map(q, row)) + ')' for row in THREAT_ROWS)})
            t(threat, name, severity, category, owasp, patterns) LEFT JOIN (
            SELECT split_part(rule_id, '/', 1) AS threat, count(DISTINCT (repo_id, path)) AS files,
            count(DISTINCT repo_id) AS repos FROM found GROUP BY 1) USING (threat)"""),
        "findings_by_severity": (js, False, """SELECT severity, pack, repo_id, path, rule_id,
            match_ord, line FROM found"""),
        "top_categories": (js, False, """SELECT pack, category, findings,
            CAST(position AS INTEGER) AS position, greatest(n - 5, 0) AS more FROM (
            SELECT *, row_number() OVER (PARTITION BY pack ORDER BY seen) AS position,
            count(*) OVER (PARTITION BY pack) AS n FROM (
            SELECT pack, category, CAST(count(*) AS BIGINT) AS findings, min(o) AS seen FROM (
            SELECT *, row_number() OVER (ORDER BY repo_id, path, rule_ord, match_ord) AS o
            FROM found) GROUP BY 1, 2)) WHERE position <= 5"""),
        "remediation_queue": (js, False, f"""WITH ranked AS (SELECT *, row_number() OVER (
            PARTITION BY severity ORDER BY {_ORDER}) AS n, CASE severity WHEN 'critical'
            THEN 9223372036854775807 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 0 END AS cap
            FROM found)
            SELECT 'finding' AS kind, severity, repo_id, path, line, rule_id, remediation,
            CAST(1 AS BIGINT) AS findings FROM ranked WHERE n <= cap
            UNION ALL SELECT 'more', severity, NULL, NULL, NULL, NULL, NULL, {_N} FROM ranked
            WHERE n > cap AND cap > 0 GROUP BY severity"""),
        "context_window": (FIXER_PACKS, False, f"""SELECT repo_id, path, rule_id, match_ord, line,
            greatest(line - 5, 1) AS first_line, array_to_string((string_split(content, {NL}))
            [greatest(line - 5, 1):line + 5], {NL}) AS context FROM found
            JOIN files USING (repo_id, path) WHERE line > 0
            AND severity IN ('critical', 'high')"""),
        "fix_order": (FIXER_PACKS, False, """SELECT repo_id, path, rule_id, match_ord, line,
            CAST(row_number() OVER (PARTITION BY repo_id, path ORDER BY line DESC, pack_ord,
            rule_ord, match_ord) AS BIGINT) AS position FROM found WHERE line > 0"""),
        "apply_fixes": (FIXER_PACKS, False, _fixing()),
        "fix_summary": (FIXER_PACKS, False, f"""SELECT CAST(coalesce(sum(fixes), 0) AS BIGINT)
            AS fixes_applied, {_N} AS files_fixed FROM ({_fixing()})"""),
        "watch_ignore": (None, False, f"""SELECT repo_id, path, op, {_N} AS changes FROM changes
            WHERE NOT regexp_matches(path, {q(IGNORED)}) GROUP BY ALL"""),
        "watch_scan": (None, False, f"""SELECT tick, repo_id, path, rule_id, match_ord, line
            FROM ({findings(['secrets'], everything=True)}) JOIN due USING (repo_id, path)"""),
        "watch_once": (None, False, f"""SELECT tick, repo_id, path, CAST(1 AS BIGINT) AS scans,
            CAST(coalesce(n, 0) AS BIGINT) AS issues FROM due JOIN files USING (repo_id, path)
            LEFT JOIN (SELECT repo_id, path, count(*) AS n
            FROM ({findings(['secrets'], everything=True)}) GROUP BY 1, 2)
            USING (repo_id, path)"""),
        "watch_batch_summary": (None, False, f"""SELECT tick, {_N} AS files_scanned,
            CAST(sum(coalesce(n, 0)) AS BIGINT) AS issues FROM due
            JOIN files USING (repo_id, path) LEFT JOIN (SELECT repo_id, path, count(*) AS n
            FROM ({findings(['secrets'], everything=True)}) GROUP BY 1, 2)
            USING (repo_id, path) GROUP BY tick"""),
    }
    return out


CTE["declared"] = """SELECT repo_id, package, arg_max(version, dev) AS version FROM (
    SELECT repo_id, dev, package,
        json_extract_string(j, '$."' || package || '"') AS version
    FROM (SELECT repo_id, dev, j, unnest(json_keys(j)) AS package FROM (
        SELECT repo_id, 0 AS dev, json_extract(content, '$.dependencies') AS j FROM files
            WHERE path = 'package.json'
        UNION ALL SELECT repo_id, 1, json_extract(content, '$.devDependencies') FROM files
            WHERE path = 'package.json') WHERE j IS NOT NULL))
    GROUP BY repo_id, package"""
# Which tables each one reads, in an order that can be written out.
_NEEDS = ("slots", "files", "later_files", "page_files", "talk_files", "file_repos", "raw_manifest", "repos",
          "manifest", "parts", "registry", "advisories", "latest", "changed", "changes", "due",
          "compliance", "rules", "env_lines", "env_issues", "env_facts", "dep_findings",
          "declared", "found")


def _with(sql: str, tables: dict[str, str]) -> str:
    """Prefix the tables a query needs, directly or through others."""
    import re

    used: set[str] = set()

    def visit(text):
        for name in _NEEDS:
            if name in tables and name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(tables[name])

    visit(sql)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({tables[n]})" for n in _NEEDS if n in used)
    # A query with tables of its own goes inside, so that its names stay local.
    return f"WITH {ctes} SELECT * FROM ({sql})"


def oracles() -> dict[str, str]:
    out = {}
    for name, (packs, with_deps, sql) in _queries().items():
        tables = dict(CTE)
        if packs is not None:
            tables["found"] = findings(list(packs))
            if with_deps:
                tables["found"] += " UNION ALL SELECT * FROM dep_findings"
        out[name] = _with(sql, tables)
    return out
