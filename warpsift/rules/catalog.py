"""All packs in report order, and the small lookup tables that go with them."""

from __future__ import annotations

from . import (api, auth, db, env, headers, iac, matrix, owasp, prompts, ratelimit, routes,
               secrets, upload, webhook)
from .base import CRITICAL, HIGH, LOW, MEDIUM, OTHER, OWASP, Pack, Rule

deps = Pack("deps", "dependency-vulnerability", "A06")
deps.add("known_cve", MEDIUM, "known-cve", emits=OTHER,
         title="Known weakness in ", fix="Move to a corrected version.")
deps.add("outdated_major", MEDIUM, "outdated-major-version", type="dependency-outdated",
         emits=OTHER, title="Package is behind: ", fix="Plan the upgrade.")
deps.add("unmaintained", MEDIUM, "unmaintained-package", type="dependency-maintenance",
         emits=OTHER, title="Package is no longer maintained: ", fix="Replace it.")
deps.add("hallucinated", HIGH, "supply-chain", type="dependency-hallucination", emits=OTHER,
         title="Package is unknown to the registry: ",
         fix="Remove it or correct the name.",
         better="Look a package up before installing it.")
deps.add("brand_new", CRITICAL, "supply-chain", type="dependency-typosquat", emits=OTHER,
         title="Package is brand new: ", fix="Make sure this is the package you meant.",
         better="Wait before adopting very new packages.")
# The supply-chain rules carry no risk class.
_NO_CLASS = {"hallucinated", "brand_new"}
deps.rules[:] = [Rule(**{**r.__dict__, "owasp": None}) if r.rule_id in _NO_CLASS else r
                 for r in deps.rules]

# Report order of the fourteen scans; the threat matrix is a catalog beside them.
SCANS = ("secrets", "owasp", "auth", "db", "api", "deps", "env", "headers", "upload", "webhook",
         "ratelimit", "prompts", "iac", "routes")
PACKS: dict[str, list[Rule]] = {
    p.name: p.rules for p in (
        secrets.PACK, owasp.PACK, auth.PACK, db.PACK, api.PACK, deps, env.PACK, headers.PACK,
        upload.PACK, webhook.PACK, ratelimit.PACK, prompts.PACK, iac.PACK, routes.PACK,
        matrix.PACK)}
PACK_ORDER = {name: i for i, name in enumerate(PACKS)}
FILE_PACKS = tuple(p for p in SCANS if p != "deps")

# Which scans each consumer reads.
JSON_REPORT_PACKS = ("secrets", "owasp", "auth", "db", "api")
DASHBOARD_PACKS = ("secrets", "owasp", "auth", "db", "api", "deps", "prompts", "iac", "routes")
FIXER_PACKS = ("secrets", "owasp", "auth", "db", "api", "prompts")

# Risk class -> attack technique and control.
COMPLIANCE = (
    (OWASP["A01"], "TA0004 Privilege Escalation / T1068", "PR.AC-1 Access is Managed"),
    (OWASP["A02"], "TA0009 Collection / T1560", "PR.DS-1 Data-at-rest is Protected"),
    (OWASP["A03"], "TA0001 Initial Access / T1190", "DE.CM-8 Vulnerability Scans"),
    (OWASP["A04"], "TA0001 Initial Access", "GV.RM-1 Risk Management Strategy"),
    (OWASP["A05"], "TA0005 Defense Evasion / T1562", "PR.IP-1 Baseline Configuration"),
    (OWASP["A06"], "TA0001 Initial Access / T1190", "ID.AM-2 Software Asset Management"),
    (OWASP["A07"], "TA0006 Credential Access / T1110", "PR.AA-1 Identity Management"),
    (OWASP["A08"], "TA0001 Initial Access / T1195", "PR.DS-6 Software Integrity"),
    (OWASP["A09"], "TA0005 Defense Evasion / T1562.001", "DE.AE-2 Log Aggregation"),
    (OWASP["A10"], "TA0008 Lateral Movement / T1210", "DE.CM-8 Vulnerability Scans"),
)

# Package names; the advice is our own wording.
UNMAINTAINED = (
    ("request", "Use the built-in fetch or another maintained client."),
    ("left-pad", "Use the padding method of strings."),
    ("moment", "Use a smaller date library."),
    ("bower", "Use a current package manager."),
    ("gulp-util", "Use the single-purpose packages."),
    ("nodemon", "Use the watch mode of your runtime."),
)
FRAMEWORKS = (
    ("express", "express", 1), ("fastify", "fastify", 2), ("@nestjs/core", "nestjs", 3),
    ("next", "nextjs", 4), ("koa", "koa", 5), ("hapi", "hapi", 6),
)
REQUIRED_FILES = (
    (".env", False), (".gitignore", True), ("package.json", True), (".eslintrc.json", False),
    ("Dockerfile", False),
)
ADVISORY_SEVERITY = {"critical": CRITICAL, "high": HIGH, "moderate": MEDIUM, "low": LOW,
                     "info": LOW}
REGISTRY_SKIP = ("file:", "git+", "github:")
NEW_PACKAGE_DAYS = 7


def rules_of(packs, extra_rules=()) -> list[Rule]:
    """Rules of the given packs in report order, extra rules last."""
    known = [r for name in PACKS if name in set(packs) for r in PACKS[name]]
    return known + [r for r in extra_rules if r.pack in set(packs)]
