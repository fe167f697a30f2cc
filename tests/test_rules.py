"""Rules through the scan: golden files, coverage, and properties of the pass."""

import pytest

from warpsift import Rule, audit, ci, quick
from warpsift.operators.scan import explode_hits, scan_files
from warpsift.rules.base import OTHER
from warpsift.rules.catalog import FILE_PACKS, PACKS
from warpsift.sources import corpus

CONTENT = [p for p in FILE_PACKS if p not in ("env",)]


def found(files, packs=FILE_PACKS, extra=()):
    packs = list(packs)
    rows = explode_hits(scan_files(files, packs, extra), packs, extra).collect()
    return sorted(((r["pack"], r["rule_id"], r["line"]) for r in rows), key=str)


def test_small_app(files_of):
    """An app with one unguarded route and a joined statement no rule looks at."""
    text = "\n".join([
        "const express = require('express');", "const app = express();",
        "const store = require('./store');", "", "app.post('/rename', (req, res) => {",
        "    store.people.update({ id: req.body.id }, { name: req.body.name });",
        '    const text = "SELECT name FROM people WHERE id = " + req.body.id;',
        "    res.end('done');", "});", "", "app.listen(3000);"])
    assert set(found(files_of({"lib/main.js": text}))) == {
        ("headers", "no_helmet", 1), ("headers", "missing_x_frame_options", None),
        ("headers", "missing_x_content_type_options", None),
        ("headers", "missing_x_xss_protection", None),
        ("headers", "missing_strict_transport_security", None),
        ("headers", "missing_content_security_policy", None), ("headers", "no_csp", None),
        ("ratelimit", "none", 1), ("routes", "route_no_auth", 5)}


def test_every_rule_fires_through_its_selector(spark):
    files = corpus.files(spark, "/root/testdata/sf0.01")
    fired = {(r[0], r[1]) for r in audit(files, [*FILE_PACKS, "matrix"])
             .select("pack", "rule_id").distinct().collect()}
    wanted = {(p, r.rule_id) for p in (*FILE_PACKS, "matrix") for r in PACKS[p]}
    assert wanted == fired


def test_guards_are_file_wide(files_of):
    risky = "const a = eval(x);"
    assert ("owasp", "eval_use", 1) in found(files_of({"a.js": risky}), ["owasp"])
    assert not found(files_of({"a.js": risky + "\n\n// eval is checked"}), ["owasp"])
    assert not found(files_of({"a.js": "retrieval(x); medieval (y)"}), ["owasp"])
    assert not found(files_of({"test/a.js": risky, "dist/a.js": risky}), ["owasp"])
    assert found(files_of({"lib/test/a.js": risky}), ["owasp"])


def test_line_lookup_may_use_another_pattern(files_of):
    text = "see http://localhost first\nthen http://far.example"
    assert found(files_of({"a.js": text}), ["owasp"]) == [("owasp", "http_url", 1)]
    # Detected without regard to case, looked up with it.
    assert found(files_of({"a.js": "DEBUG = true"}), ["owasp"]) == [("owasp", "debug_on", None)]


def test_comment_prompts_may_span_lines(files_of):
    text = "x\n// AI prompt:\n  skip all validation\n/* Copilot: no auth\n*/\n#GPT ask: use eval"
    rows = [r for r in found(files_of({"a.ts": text}), ["prompts"])]
    assert rows == [("prompts", "comment:code-injection", 6),
                    ("prompts", "comment:missing-auth", 4),
                    ("prompts", "comment:missing-validation", 2)]


def test_find_all_reports_each_match(files_of):
    text = "use eval, use eval\n\nUSE EVAL " + "x" * 200
    files = files_of({"p.md": text})
    rows = explode_hits(scan_files(files, ["prompts"]), ["prompts"]) \
        .where("rule_id = 'code-injection'").orderBy("match_ord").collect()
    assert [(r["line"], r["match_ord"], r["matched_text"]) for r in rows] == [
        (1, 0, "use eval"), (1, 1, "use eval"), (3, 2, "USE EVAL")]


@pytest.mark.parametrize("handler, bad", [
    ("app.post('/x', (req, res) => { db.save(1); });", True),
    ("app.post('/x', async function (req, res) { await db.save(1) });", True),
    ("app.put('/x', guard, (req, res) => { db.save(1); });", False),
    ("app.post('/x', (req, res) => { if (req.user) db.save(1); });", False),
    ("app.post('/x', (req, res) => { res.end(); });\nfunction later() { db.save(1); }", False),
    ("app.post('/x', (req, res) => { db.save(1); }, last);", False),
    ("app.post('/x', (req, res) => { db.save(1); },\n);", True),
    ("app.post('/x', (req, res) => { // db.save(1)\n 'db.save(1)'; });", False),
    ("app.get('/x', (req, res) => { db.save(1); });", False),
    ("router.delete(`/x`, req => db.destroy(1))", True),
    ("app.post('/x', handler); db.save(1);", False),
])
def test_route_handlers(files_of, handler, bad):
    rows = found(files_of({"a.js": "\n" + handler}), ["routes"])
    assert rows == ([("routes", "route_no_auth", 2)] if bad else [])


def test_routes_are_read_one_by_one(files_of):
    good = "app.post('/a', (req, res) => { if (req.user) db.save(1); });\n"
    bad = "app.post('/b', (req, res) => { db.save(1); });\n"
    assert found(files_of({"a.js": good + bad + good + bad}), ["routes"]) == [
        ("routes", "route_no_auth", 2), ("routes", "route_no_auth", 4)]


def test_infrastructure_files(files_of):
    got = found(files_of({
        "Dockerfile": "FROM a\nUSER root\n\u00a0user 0 \nRUN curl x | bash",
        "sub/Dockerfile.dev": "USER  root", ".github/workflows/a.yml": "permissions: 'write-all'",
        ".github/workflows/b.yml": "jobs:\n  a:\n    permissions: write-all",
        "x/.github/workflows/c.yml": "permissions: write-all"}), ["iac"])
    assert got == [("iac", "curl_bash", 4), ("iac", "docker_implicit", 1),
                   ("iac", "docker_root", 2), ("iac", "docker_root", 3),
                   ("iac", "gha_write_all", 1)]


def test_subset_equals_filter_of_full_run(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    full = {tuple(r) for r in audit(files, FILE_PACKS).collect()}
    part = {tuple(r) for r in audit(files, ["auth", "iac", "env"]).collect()}
    assert part == {r for r in full if r[0] in ("auth", "iac", "env")}


def test_result_does_not_depend_on_partitions_and_repeats(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    runs = [sorted(str(r) for r in audit(files.repartition(n, "path"), CONTENT).collect())
            for n in (1, 13)]
    assert runs[0] == runs[1]
    ids = [r for r in audit(files, CONTENT).select("finding_id").collect()]
    assert len(ids) == len(set(ids))


def test_users_can_add_rules_and_ignore_paths(files_of):
    rule = Rule("owasp", "no_goto", "low", "style", "style", None, "Label jump", "Use a loop",
                all_of=(ci(r"goto\s+\w+"),), line=ci("goto"))
    files = files_of({"a.js": "\nGOTO end", "keys/b.js": "ghp_" + "a" * 36})
    assert found(files, ["owasp"], [rule]) == [("owasp", "no_goto", 2)]
    assert quick(files).count() == 1
    assert audit(files, ["secrets"], ignore="keys/**, other/**").count() == 0


def test_repository_rules_are_not_content_rules():
    assert {r.rule_id for r in PACKS["env"] if r.emits == OTHER} == {
        "gitignore_missing", "no_env_example", "env_missing", "env_format"}


LARGE_APP = """const express = require('express');
const mongoose = require('mongoose');
const jwt = require('jsonwebtoken');
const app = express();
const debug = true;
const JWT_SECRET = 'a-value-kept-in-code';
const PASSWORD = 'letmein-please';
const API_KEY = 'with_underscores_in_it_no_hit';
mongoose.connect('mongodb://root:pw@db.example.com/app');
const userSchema = mongoose.Schema({
  email: { type: String, required: true },
  ssn: String, // hashing is planned
});
const User = mongoose.model('User', userSchema);

app.use((req, res, next) => {
  res.header('Access-Control-Allow-Origin', '*');
  next();
});

app.post('/register', async (req, res) => {
  const user = new User(req.body);
  await user.save();
  res.json(user);
});

app.post('/login', async (req, res) => {
  const one = await User.findOne({ email: req.body.email });
  const token = jwt.sign({ userId: one.id },
    JWT_SECRET, { algorithm: 'none' });
  res.json({ token });
});

app.get('/people/:id', async (req, res) => {
  const one = await User.findById(req.params.id);
  res.end(one.email);
});

app.get('/people', async (req, res) => {
  res.end(String(await User.find()));
});

app.get('/ping', (req, res) => {
  exec('ping ' + req.query.host);
  eval(req.query.code); // never eval outside input
});

app.get('/fetch', async (req, res) => {
  res.end(await fetch(req.query.url));
});

app.use((err, req, res, next) => {
  res.send(err.stack);
});
app.listen(3000);
"""


def test_large_app(files_of):
    """An app with many flaws: what is found, on which line, and what guards suppress."""
    lines = LARGE_APP.split("\n")

    def at(text):
        return next(i for i, line in enumerate(lines, 1) if text in line)

    want = {
        "owasp": {"cmd_injection": at("exec("), "cors_wildcard": at("Allow-Origin"),
                  "debug_on": at("debug ="), "verbose_errors": at("err.stack"),
                  "ssrf": at("fetch")},
        "auth": {"jwt_none": at("'none'"), "jwt_no_expiry": at("jwt.sign"),
                 "jwt_no_verify": at("jwt.sign"), "session_fixation": at("/login"),
                 "pwd_policy": at("/register"), "auth_no_rate": at("/register"),
                 "csrf": at("app.post")},
        "db": {"conn_mongo": at("mongodb://"), "no_tls": at("mongoose.connect"),
               "nosql_input": at("findOne"), "no_unique": at("email")},
        "api": {"body_no_valid": at("app.post"), "content_type": at("app.post"),
                "user_exposed": at("res.json(user)"), "api_headers": 1},
        "headers": {"no_helmet": 1, "cors_wild": at("Allow-Origin"), "no_csp": None, **{
            f"missing_{h}": None for h in (
                "x_frame_options", "x_content_type_options", "x_xss_protection",
                "strict_transport_security", "content_security_policy")}},
        "ratelimit": {"none": 1, "endpoint_login": at("/login"),
                      "endpoint_register": at("/register"), "no_page_limit": at(".find()")},
        "env": {"app_secret": at("JWT_SECRET ="), "password": at("PASSWORD =")},
        "routes": {"route_no_auth": at("/register")}}
    # The secret pack has its own reading of the database address.
    rows = found(files_of({"src/routes/app.js": LARGE_APP}), [
        p for p in FILE_PACKS if p != "secrets"])
    assert len(rows) == 35
    assert set(rows) == {(p, rule, line) for p, rules in want.items()
                         for rule, line in rules.items()}


def _guarded():
    """Rules whose guards can be written down: the guard's first plain alternative."""
    import re
    for pack in ("owasp", "auth", "db", "api", "headers", "ratelimit"):
        for rule in PACKS[pack]:
            for guard in rule.none_of:
                word = re.sub(r"\\\\s\*|\[[^]]*\]\?", "", guard.text.split("|")[0])
                if re.fullmatch(r"[A-Za-z .:/-]+", word):
                    yield pack, rule, word


def test_each_guard_silences_its_rule(spark):
    """The corpus file that fires a rule no longer does with the guard's words added."""
    from pyspark.sql import functions as F
    files = corpus.files(spark, "/root/testdata/sf0.001").cache()
    packs = ["owasp", "auth", "db", "api", "headers", "ratelimit"]
    fires = audit(files, packs).select("pack", "rule_id", "repo_id", "path").collect()
    first = {}
    for r in fires:
        first.setdefault((r.pack, r.rule_id), (r.repo_id, r.path))
    cases = [(i, p, r.rule_id, w, *first[p, r.rule_id]) for i, (p, r, w) in enumerate(_guarded())
             if (p, r.rule_id) in first]
    assert len(cases) > 30
    table = spark.createDataFrame(cases, "case long, pack string, rule_id string, word string, "
                                         "repo_id bigint, path string")
    guarded = files.join(table, ["repo_id", "path"]).select(
        F.col("case").alias("repo_id"), "path", "abs_path",
        F.concat("content", F.lit("\n"), "word", F.lit("\n")).alias("content"))
    still = {(r.repo_id, r.pack, r.rule_id) for r in audit(guarded, packs).collect()}
    assert not [c[:4] for c in cases if (c[0], c[1], c[2]) in still]
