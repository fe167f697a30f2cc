"""Response-header rules. Patterns, severities and categories are fixed values."""

from .base import CRITICAL, HIGH, MEDIUM, Pack, ci

PACK = Pack("headers", "http-headers", "A05")
add = PACK.add

add("no_helmet", HIGH, "missing-helmet", has=r"express", lacks=r"helmet",
    title="Express app without header middleware",
    fix="Add a header middleware as the first handler.",
    better="Set protective headers in one place for the whole app.")
add("cors_wild", MEDIUM, "cors-wildcard",
    has=r"Access-Control-Allow-Origin.*\*", line=r"Access-Control-Allow-Origin",
    title="Cross-origin header allows everyone",
    fix="Answer with the calling origin only if it is on a list.",
    better="Keep the list of origins in configuration.")
add("cors_creds", CRITICAL, "cors-credentials-wildcard",
    has=[r"cors\s*\(", r"origin.*\*", r"credentials.*true"],
    title="Credentials accepted from every origin",
    fix="Never combine credentials with a wildcard origin.",
    better="Credentials need an explicit origin list.")
for rule_id, header, guard in (
    ("missing_x_frame_options", "X-Frame-Options", r"X-Frame-Options|frameguard"),
    ("missing_x_content_type_options", "X-Content-Type-Options", r"X-Content-Type-Options|noSniff"),
    ("missing_x_xss_protection", "X-XSS-Protection", r"X-XSS-Protection|xssFilter"),
    ("missing_strict_transport_security", "Strict-Transport-Security",
     r"Strict-Transport-Security|hsts"),
    ("missing_content_security_policy", "Content-Security-Policy",
     r"Content-Security-Policy|contentSecurityPolicy"),
):
    add(rule_id, MEDIUM, "missing-security-header",
        has=r"express|server|app\.listen", lacks=[r"helmet", ci(guard)], line=None,
        title=f"Header {header} is not set", fix=f"Send {header} with every answer.",
        better="A header middleware sets it by default.")
add("no_hsts", MEDIUM, "missing-hsts",
    has=r"https|production", lacks=r"Strict-Transport-Security|hsts|max-age", line=None,
    title="Transport security is not made permanent",
    fix="Send a strict transport header with a long life.",
    better="Start short, then extend to a year.")
add("no_csp", HIGH, "missing-csp",
    has=r"express|server", lacks=r"Content-Security-Policy|csp|helmet", line=None,
    title="No content policy",
    fix="Define which sources a page may load.",
    better="Begin in report-only mode.")
