"""Rules that are added to a stored estate later, one of each kind."""

from ..rules.base import CRITICAL, HIGH, LOW, PER_MATCH, Pattern, Rule, ci

_DRIVER = Pattern(r"mongodb:\/\/|mysql:\/\/")
_QUERY = Pattern(r"\.query\s*\(`")
_ALGORITHM = ci(r"algorithm:\s*'none'")

LATE_RULES = (
    Rule("db", "late_plain_driver", HIGH, "missing-encryption", "database-security", "A02",
         "Database address without encryption", "Turn on encryption in the address.",
         all_of=(_DRIVER,), none_of=(ci(r"tls=true"),), line=_DRIVER),
    Rule("owasp", "late_template_query", CRITICAL, "sql-injection", "vulnerability", "A03",
         "Request value inside a statement", "Use bind parameters.",
         all_of=(_QUERY, Pattern(r"req\.(?:query|body)\.")), none_of=(Pattern(r"escape\("),),
         line=_QUERY),
    Rule("auth", "late_no_algorithm", CRITICAL, "weak-token", "authentication", "A07",
         "Token signed with no algorithm", "Name a strong algorithm.",
         all_of=(_ALGORITHM,), path_none=(Pattern(r"\.test\."),), longer_than=40,
         line=_ALGORITHM),
    Rule("secrets", "late_address", LOW, "internal-address", "secret", None,
         "Internal address in a file", "Read the address from the environment.",
         all_of=(Pattern(r"https?:\/\/[a-z]+\.example\.com"),), emits=PER_MATCH,
         match_chars=30, env_var="SERVICE_URL"),
)
