"""Rules are plain data: what to look for, how severe it is, what to tell the reader."""

from __future__ import annotations

from dataclasses import dataclass, field

CRITICAL, HIGH, MEDIUM, LOW = "critical", "high", "medium", "low"
SEVERITIES = (CRITICAL, HIGH, MEDIUM, LOW)
SEVERITY_RANK = {name: rank for rank, name in enumerate(SEVERITIES)}

# The ten 2021 risk classes, spelled as findings carry them.
OWASP = {
    "A01": "A01:2021 – Broken Access Control",
    "A02": "A02:2021 – Cryptographic Failures",
    "A03": "A03:2021 – Injection",
    "A04": "A04:2021 – Insecure Design",
    "A05": "A05:2021 – Security Misconfiguration",
    "A06": "A06:2021 – Vulnerable and Outdated Components",
    "A07": "A07:2021 – Identification and Authentication Failures",
    "A08": "A08:2021 – Software and Data Integrity Failures",
    "A09": "A09:2021 – Security Logging and Monitoring Failures",
    "A10": "A10:2021 – Server-Side Request Forgery (SSRF)",
}


@dataclass(frozen=True)
class Pattern:
    """A regular expression in the catalog's dialect (see functions/patterns.py)."""

    text: str
    ignore_case: bool = False


def ci(text: str) -> Pattern:
    """A pattern that ignores the case of ASCII letters."""
    return Pattern(text, True)


def as_pattern(value: str | Pattern) -> Pattern:
    return value if isinstance(value, Pattern) else Pattern(value)


FIRST = object()  # line of the rule's own first pattern

# How a rule turns a matching file into findings.
PER_FILE = "file"  # at most one finding per file, on the first line of `line`
PER_MATCH = "match"  # one finding per match of all_of[0], each on its own line
OTHER = "other"  # produced by a dedicated operator (lines, repo level, joins)


@dataclass(frozen=True)
class Rule:
    pack: str
    rule_id: str
    severity: str
    category: str
    type: str
    owasp: str | None
    title: str
    remediation: str
    all_of: tuple[Pattern, ...] = ()
    none_of: tuple[Pattern, ...] = ()
    path_all: tuple[Pattern, ...] = ()
    path_none: tuple[Pattern, ...] = ()
    longer_than: int | None = None
    line: Pattern | int | None = None
    best_practice: str | None = None
    env_var: str | None = None
    emits: str = PER_FILE
    match_chars: int | None = None  # matched text is cut there in findings; None: whole

    def __post_init__(self):
        if self.emits == PER_FILE and not (self.all_of or self.none_of or self.path_all
                                           or self.path_none or self.longer_than is not None):
            raise ValueError(f"rule {self.rule_id} has no condition")

    @property
    def owasp_ref(self) -> str | None:
        return OWASP[self.owasp] if self.owasp else None


@dataclass
class Pack:
    """Collects the rules of one pack under shared defaults."""

    name: str
    type: str
    owasp: str | None = None
    match_chars: int | None = None
    rules: list[Rule] = field(default_factory=list)

    def add(self, rule_id, severity, category, *, title, fix, has=(), lacks=(), path=(),
            path_lacks=(), line=FIRST, owasp=None, type=None, better=None, env_var=None,
            longer_than=None, emits=PER_FILE):
        listed = [tuple(as_pattern(p) for p in (v if isinstance(v, (list, tuple)) else [v]))
                  for v in (has, lacks, path, path_lacks)]
        if line is FIRST:
            line = listed[0][0] if listed[0] else None
        elif isinstance(line, str):
            line = Pattern(line)
        self.rules.append(Rule(
            self.name, rule_id, severity, category, type or self.type, owasp or self.owasp,
            title, fix, *listed, longer_than=longer_than, line=line, best_practice=better,
            env_var=env_var, emits=emits, match_chars=self.match_chars))
