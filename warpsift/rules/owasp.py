"""General web-risk rules. Patterns, severities and categories are fixed values."""

from .base import CRITICAL, HIGH, LOW, MEDIUM, Pack, ci

PACK = Pack("owasp", "injection", "A03")
add = PACK.add

add("sql_interp", CRITICAL, "sql-injection",
    has=r"""(?:query|execute)\s*\(\s*['"`].*\$\{.*\}.*['"`]""",
    title="SQL text built by interpolating values",
    fix="Bind values as parameters of a prepared statement instead of pasting them into the text.")
add("sql_concat", CRITICAL, "sql-injection",
    has=r"""(?:query|execute)\s*\(\s*['"`].*\+.*\+.*['"`]""",
    title="SQL text built by joining strings",
    fix="Pass the values separately as bind parameters.")
add("mysql_concat", CRITICAL, "sql-injection",
    has=r"mysql\.query\s*\([^)]*\+",
    title="MySQL call joins strings into its statement",
    fix="Use placeholders and hand the values over as an array.")
add("sequelize_tpl", CRITICAL, "sql-injection",
    has=r"sequelize\.query\s*\([^)]*\$\{",
    title="Raw Sequelize statement contains a template value",
    fix="Use model methods, or named replacements for raw statements.")
add("cmd_injection", CRITICAL, "command-injection",
    has=[r"exec\s*\(|execSync\s*\(|spawn\s*\(", r"\$\{|concat|\+"], line=r"exec\s*\(",
    title="Shell command may contain outside input",
    fix="Avoid the shell; pass a fixed program and a checked argument list.")

add("inner_html", HIGH, "dom-based-xss", type="xss",
    has=r"\.innerHTML\s*=",
    title="Markup assigned straight to an element",
    fix="Assign plain text, or clean the markup first.")
add("react_html", HIGH, "react-xss", type="xss",
    has=r"dangerouslySetInnerHTML",
    title="React component renders unescaped markup",
    fix="Render text children, or clean the markup before handing it over.")
add("document_write", MEDIUM, "document-write", type="xss",
    has=r"document\.write\s*\(", line=r"document\.write",
    title="Page written with document.write",
    fix="Build nodes with the DOM interface.")
add("eval_use", CRITICAL, "code-evaluation", type="xss",
    has=r"\beval\s*\(", lacks=r"\/\/.*eval",
    title="Text evaluated as program code",
    fix="Replace evaluation by a parser or a lookup of allowed actions.")

add("weak_hash", CRITICAL, "weak-hashing", owasp="A07", type="broken-auth",
    has=[r"md5\s*\(|sha1\s*\(", ci(r"password")], line=r"md5|sha1",
    title="Password handled with an outdated digest",
    fix="Hash passwords with bcrypt, scrypt or argon2.")
add("default_creds", CRITICAL, "default-credentials", owasp="A07", type="broken-auth",
    has=ci(r"""password\s*[=:]\s*['"](admin|password|123456)['"]"""), line=r"password\s*[=:]",
    title="Well-known default password in the source",
    fix="Delete the default and require a password at set-up time.")

add("http_url", HIGH, "insecure-transport", owasp="A02", type="sensitive-data-exposure",
    has=r"http:\/\/(?!localhost|127\.0\.0\.1)", line=r"http:\/\/",
    title="Address without transport encryption",
    fix="Call the address over https.")
add("log_sensitive", HIGH, "sensitive-data-logging", owasp="A02", type="sensitive-data-exposure",
    has=ci(r"console\.(log|info|debug)\s*\(.*(?:password|token|secret|key|credit[-_]?card|ssn)"),
    line=r"console\.(log|info|debug)",
    title="Sensitive value written to the log",
    fix="Leave the value out or mask it before logging.")
add("card_storage", CRITICAL, "pci-compliance", owasp="A02", type="sensitive-data-exposure",
    has=[ci(r"credit[-_]?card|card[-_]?number|cc[_-]?num"), ci(r"(?:save|store|insert|create)")],
    line=ci(r"credit[-_]?card|card[-_]?number"),
    title="Payment card data appears to be kept",
    fix="Let a payment provider hold card data and keep only its token.")

add("cors_wildcard", MEDIUM, "cors-wildcard", owasp="A05", type="security-misconfiguration",
    has=r"Access-Control-Allow-Origin.*\*", line=r"Access-Control-Allow-Origin",
    title="Every origin may read responses",
    fix="List the origins that need access.")
add("debug_on", MEDIUM, "debug-enabled", owasp="A05", type="security-misconfiguration",
    has=ci(r"debug\s*[=:]\s*(true|1)"), path_lacks=ci(r"test|spec"), line=r"debug\s*[=:]",
    title="Debug switch left on",
    fix="Take the switch from the environment and default to off.")
add("verbose_errors", MEDIUM, "verbose-errors", owasp="A05", type="security-misconfiguration",
    has=[r"error\.message|error\.stack|err\.stack", r"res\.send|res\.json"],
    line=r"error\.stack|err\.stack",
    title="Internal error details reach the client",
    fix="Log the details and answer with a general message.")

add("missing_authz", HIGH, "missing-authz", owasp="A01", type="broken-access-control",
    path=ci(r"admin|manage|delete|update"), lacks=ci(r"auth|middleware|guard|protect"),
    has=r"(app\.get|app\.post|router\.get|router\.post)",
    line=r"app\.(get|post)|router\.(get|post)",
    title="Privileged route without an access check",
    fix="Put an authorization check in front of the handler.")
add("idor", HIGH, "idor", owasp="A01", type="broken-access-control",
    has=[r"req\.params\.id|req\.query\.id", r"findById|findOne"],
    lacks=ci(r"userId|ownerId|belongs"),
    title="Record fetched by a caller-chosen id",
    fix="Filter the lookup by the owner of the record.")
add("unsafe_deser", MEDIUM, "unsafe-deserialization", owasp="A08", type="integrity-failure",
    has=r"JSON\.parse\s*\(.*req\.(body|params|query)", line=r"JSON\.parse",
    title="Request data parsed without a schema",
    fix="Check the parsed value against a schema before use.")
add("auth_not_logged", LOW, "auth-events-not-logged", owasp="A09", type="insufficient-logging",
    has=[ci(r"(?:login|logout|register|password[_-]?reset)"),
         ci(r"(async|function).*?(login|auth|register)")],
    lacks=ci(r"log|audit|track|monitor"), line=r"login|register|auth",
    title="Account events leave no trace",
    fix="Write an audit record for each account event.")
add("ssrf", HIGH, "user-controlled-url", owasp="A10", type="ssrf",
    has=r"(?:fetch|axios\.get|http\.get)\s*\(.*req\.(body|params|query)",
    line=r"fetch|axios\.get",
    title="Server fetches an address chosen by the caller",
    fix="Allow only addresses from a fixed list.")
