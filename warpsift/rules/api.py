"""API rules. Patterns, severities and categories are fixed values."""

from .base import HIGH, LOW, MEDIUM, Pack, ci

PACK = Pack("api", "api-security", "A04")
add = PACK.add

add("body_no_valid", HIGH, "missing-input-validation", owasp="A03",
    has=[r"(app\.post|router\.post|app\.put|router\.put)", r"req\.body"],
    lacks=r"validate|schema|joi|yup|zod|express-validator",
    line=r"app\.(post|put)|router\.(post|put)",
    title="Request body used without validation",
    fix="Check the body against a schema.")
add("content_type", LOW, "missing-content-type-check", owasp="A05",
    has=r"(app\.post|router\.post)", lacks=r"content-type|application\/json",
    title="Content type of requests not checked",
    fix="Refuse requests of an unexpected content type.")
add("user_exposed", HIGH, "sensitive-data-exposure", owasp="A02",
    has=ci(r"res\.json.*user|res\.send.*user"), lacks=r"pick|omit|select|exclude",
    title="Whole user record returned",
    fix="Return a list of chosen fields.")
add("verbose_500", MEDIUM, "verbose-error-messages", owasp="A05",
    has=[r"catch.*err", r"res\.status\(500\).*err"], line=r"res\.status\(500\)",
    title="Server error answers carry the error",
    fix="Send a general message with a reference number.")
add("api_no_rate", MEDIUM, "missing-rate-limiting",
    path=r"\/api\/", lacks=r"rate[-_]?limit|express-rate-limit|throttle",
    line=r"app\.(get|post|put|delete)|router\.",
    title="API file without a rate limit",
    fix="Limit calls per client.")
add("api_headers", MEDIUM, "missing-security-headers", owasp="A05",
    has=r"express", lacks=r"helmet|X-Frame-Options|Content-Security-Policy",
    title="API answers lack protective headers",
    fix="Install a header middleware.")
add("api_cors", MEDIUM, "cors-misconfiguration", owasp="A05",
    has=[r"cors\s*\(", r"""origin:\s*['"]\*['"]"""],
    title="API accepts every origin",
    fix="Name the origins that may call it.")
add("no_pagination", LOW, "missing-pagination",
    has=r"\.find\s*\(\)\.exec\(\)|\.findAll\(\)", lacks=r"limit|skip|page|paginate",
    line=r"\.find\s*\(\)",
    title="List call returns everything",
    fix="Return pages of bounded size.")
add("unbounded_limit", MEDIUM, "unbounded-results",
    has=r"limit.*req\.query", lacks=r"Math\.min|maxLimit",
    title="Caller picks the result size freely",
    fix="Clamp the requested size.")
add("no_version", LOW, "missing-versioning",
    path=r"\/api\/", lacks=r"\/v\d+|\/api\/v", line=r"\/api\/",
    title="API path carries no version",
    fix="Put a version into the path.")
