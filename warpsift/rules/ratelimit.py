"""Rate-limit rules. Patterns, severities and categories are fixed values."""

from .base import HIGH, MEDIUM, Pack, ci

PACK = Pack("ratelimit", "rate-limiting", "A04")
add = PACK.add

add("none", HIGH, "no-rate-limiting",
    has=r"express|app\.listen|server",
    lacks=ci(r"rate[-_]?limit|express-rate-limit|throttle|redis"), line=r"express|app\.listen",
    title="Server without any rate limit",
    fix="Add a limiter for all routes.", better="Count in a shared store.")
for rule_id, pattern, label in (
    ("endpoint_login", r"\/login|\/signin|\/auth", "sign-in"),
    ("endpoint_register", r"\/register|\/signup", "sign-up"),
    ("endpoint_reset", r"\/password.*reset|\/forgot.*password", "password reset"),
    ("endpoint_verify", r"\/api\/.*verify|\/verify.*code", "verification"),
):
    add(rule_id, HIGH, "unprotected-sensitive-endpoint", owasp="A07",
        has=pattern, lacks=r"rate[-_]?limit|throttle",
        title=f"No rate limit on {label}", fix=f"Limit {label} attempts tightly.",
        better="Count per account and per address.")
add("unbounded_param", MEDIUM, "unbounded-query-parameter",
    has=r"limit.*req\.query|limit.*req\.params", lacks=ci(r"Math\.min|max.*limit|clamp"),
    line=r"limit.*req\.",
    title="Size parameter is not bounded",
    fix="Clamp it to a maximum.", better="Document the maximum.")
add("no_page_limit", MEDIUM, "missing-pagination-limits",
    has=r"\.find\(\)|\.findAll\(\)", lacks=r"limit|skip|page|paginate",
    title="Query reads a whole collection",
    fix="Ask for one page at a time.", better="Use cursors.")
add("weak_auth_limit", MEDIUM, "weak-auth-rate-limit", owasp="A07",
    has=[ci(r"(?:login|auth|token)"), r"rate", r"max:\s*(100|200|500|1000)"], line=r"max:",
    title="Sign-in limit is far too high",
    fix="Allow a handful of attempts.", better="Slow down after each failure.")
for rule_id, pattern, label in (
    ("expensive_hash", r"bcrypt\.hash|argon2\.hash", "password hashing"),
    ("expensive_image", r"sharp\(|gm\(|imagemagick", "image work"),
    ("expensive_report", r"pdf|excel|report.*generate", "report generation"),
):
    add(rule_id, MEDIUM, "unprotected-expensive-operation",
        has=pattern, lacks=r"rate[-_]?limit|queue|throttle|job",
        title=f"Unlimited {label}", fix=f"Queue or limit {label}.",
        better="Protect costly work with quotas.")
