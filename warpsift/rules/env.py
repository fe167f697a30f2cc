"""Environment rules. Patterns, severities and categories are fixed values."""

from .base import CRITICAL, HIGH, LOW, MEDIUM, OTHER, Pack, ci

PACK = Pack("env", "environment-variable", "A07")
add = PACK.add

add("db_uri", CRITICAL, "hardcoded-db-uri",
    has=r"""(MONGODB_URI|DATABASE_URL|MONGO_URL)\s*[=:]\s*['"]mongodb""",
    title="Database address in the source", fix="Move the address to the environment.")
add("app_secret", CRITICAL, "hardcoded-secret",
    has=r"""(JWT_SECRET|SECRET_KEY|APP_SECRET)\s*[=:]\s*['"][^'"]{8,}['"]""",
    title="Application secret in the source", fix="Move the secret to the environment.")
add("api_key", CRITICAL, "hardcoded-api-key",
    has=r"""(API_KEY|STRIPE_|SENDGRID_|AWS_|OPENAI_)[A-Z_]*\s*[=:]\s*['"][a-zA-Z0-9]{16,}['"]""",
    title="API key in the source", fix="Move the key to the environment.")
add("password", CRITICAL, "hardcoded-password",
    has=ci(r"""(PASSWORD|PASSWD|PWD)\s*[=:]\s*['"][^'"]+['"]"""),
    title="Password in the source", fix="Move the password to the environment.")
add("session_secret", HIGH, "hardcoded-session-secret",
    has=r"""(SESSION_SECRET|COOKIE_SECRET)\s*[=:]\s*['"][^'"]+['"]""",
    title="Session secret in the source", fix="Move the secret to the environment.")

add("gitignore_missing", CRITICAL, "gitignore-missing", emits=OTHER,
    title="Environment file is not ignored by version control",
    fix="List .env in .gitignore.")
add("no_env_example", MEDIUM, "missing-env-example", emits=OTHER,
    title="No sample environment file", fix="Add .env.example with names and no values.")
add("env_missing", HIGH, "missing-env-file", emits=OTHER,
    title="Secrets in the source and no environment file",
    fix="Create .env and move the secrets there.")
add("env_format", LOW, "invalid-env-format", emits=OTHER,
    title="Environment file is malformed", fix="Correct the listed lines.")

# Checks of each line of an environment file.
KEY_FORM = r"^[A-Z_][A-Z0-9_]*=.*"
SPACED = r"\s+=\s+"
UNQUOTED = r"=[^\s].*[\s$`]"
QUOTED = r"""=['"].*['"]"""
ISSUE_KEY = "Line is not of the form NAME=value"
ISSUE_SPACES = "Spaces around the equals sign"
ISSUE_QUOTES = "Value with special characters needs quotes"
