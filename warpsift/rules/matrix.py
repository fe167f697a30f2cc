"""Threat matrix: ten threats, twenty patterns. All values are fixed values."""

from .base import CRITICAL, HIGH, MEDIUM, OWASP, Pack, ci

# id, name, severity, category, risk class, patterns
THREATS = (
    ("VC-01", "Secrets and credentials in code", CRITICAL, "secrets", "A07",
     (r"(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}",
      r"sk_live_[0-9a-zA-Z]{24}",
      r"mongodb(\+srv)?:\/\/[^:\s]+:[^@\s]+@[^\s]+",
      r"ghp_[A-Za-z0-9_]{36}")),
    ("VC-02", "Query injection", CRITICAL, "injection", "A03",
     (r"""query\s*\(\s*['"`].*\$\{.*\}""",
      r"""query\s*\(\s*['"`].*\+.*\+""",
      r"\.find\s*\(.*req\.body")),
    ("VC-03", "Weak sign-in and access checks", CRITICAL, "authentication", "A07",
     (r"jwt\.sign.*algorithm.*none",
      r"password.*md5|sha1",
      r"req\.params\.id.*findById")),
    ("VC-04", "Unchecked dependencies", HIGH, "dependencies", "A06", ()),
    ("VC-05", "Records open by guessing ids", HIGH, "access-control", "A01",
     (r"findById\(req\.params\.id\)",
      r"findOne\(.*req\.query")),
    ("VC-06", "Cross-site scripting", HIGH, "xss", "A03",
     (r"dangerouslySetInnerHTML",
      r"\.innerHTML\s*=",
      r"document\.write\s*\(",
      r"\beval\s*\(")),
    ("VC-07", "Unknown deployments", MEDIUM, "infrastructure", "A05", ()),
    ("VC-08", "Data leaks and logging", HIGH, "data-exposure", "A02",
     (ci(r"console\.(log|info|debug).*password|token|secret"),
      r"res\.json.*err\.stack")),
    ("VC-09", "Business rules decided by the client", CRITICAL, "business-logic", "A08",
     (r"price.*req\.body",
      r"amount.*client")),
    ("VC-10", "No audit trail", MEDIUM, "logging", "A09", ()),
)

PACK = Pack("matrix", "threat-matrix", None)
for threat, name, severity, category, owasp, patterns in THREATS:
    for number, pattern in enumerate(patterns, start=1):
        PACK.add(f"{threat}/{number}", severity, category, owasp=owasp, has=pattern,
                 title=f"{threat} {name}", fix="See the guidance for this threat.")

THREAT_ROWS = [(t, n, s, c, OWASP[o], len(p)) for t, n, s, c, o, p in THREATS]
