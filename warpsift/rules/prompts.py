"""Prompt rules. Patterns, severities and categories are fixed values."""

from .base import CRITICAL, HIGH, MEDIUM, PER_MATCH, Pack, ci

# Findings of prompts quote this much of a match.
MATCH_CHARS = 100
PACK = Pack("prompts", "ai-prompt-security", "A04", match_chars=MATCH_CHARS)

# Text of a comment that instructs a code assistant: line, block and hash comments.
COMMENTS = (
    ci(r"\/\/\s*(?:AI|GPT|Claude|Copilot|Cursor).*?:\s*(.*)"),
    ci(r"\/\*\s*(?:AI|GPT|Claude|Copilot|Cursor).*?:\s*([\s\S]*?)\*\/"),
    ci(r"#\s*(?:AI|GPT|Claude|Copilot|Cursor).*?:\s*(.*)"),
)
COMMENT_PREFIX = "comment:"

# Phrases searched for in prompt files (every match) and in comments (once per comment).
PHRASES = (
    ("insecure-mindset", HIGH,
     r"just make it work|make it work|quick and dirty|doesn't need to be perfect",
     "Prompt puts speed before safety", "Ask for a safe version from the start."),
    ("missing-validation", CRITICAL,
     r"skip.*validation|no need.*validate|don't.*check.*input|ignore.*errors",
     "Prompt asks to leave out checks", "Ask for validation of every input."),
    ("hardcoded-secrets", CRITICAL,
     r"hardcode.*key|hardcode.*secret|put.*key.*here|temporary.*password",
     "Prompt asks to embed a secret", "Ask for secrets from the environment."),
    ("missing-auth", CRITICAL,
     r"no auth|skip auth|public.*endpoint|no.*authentication|anyone can access",
     "Prompt asks for open access", "State who may call the feature."),
    ("cors-misconfiguration", MEDIUM,
     r"disable.*cors|allow.*all origins|cors.*wildcard|\*.*origin",
     "Prompt asks to open cross-origin access", "Name the permitted origins."),
    ("sensitive-data-leak", HIGH,
     r"log.*password|console\.log.*token|print.*secret|expose.*credentials",
     "Prompt asks to print secrets", "Ask for masked logs."),
    ("code-injection", CRITICAL,
     r"use eval|execute.*string|dynamic.*code|run.*user.*input",
     "Prompt asks to run text as code", "Ask for a list of allowed actions."),
    ("sql-injection-risk", CRITICAL,
     r"sql.*\+.*concat|string.*interpolation.*query|\$\{.*\}.*sql",
     "Prompt asks for pasted SQL", "Ask for bind parameters."),
    ("xss-risk", HIGH,
     r"innerHTML|dangerouslySetInnerHTML|document\.write",
     "Prompt asks for raw markup", "Ask for escaped output."),
    ("missing-rate-limit", MEDIUM,
     r"no rate limit|unlimited requests|no throttling|skip.*rate.*limit",
     "Prompt asks for unlimited calls", "Ask for sensible limits."),
    ("data-storage-risk", CRITICAL,
     r"store.*credit.card|save.*password.*plain|keep.*ssn.*database",
     "Prompt asks to keep sensitive data", "Ask for encryption or tokens."),
    ("error-handling", MEDIUM,
     r"catch.*err.*console|swallow.*error|ignore.*exception|empty catch",
     "Prompt asks to hide errors", "Ask for logged and reported errors."),
)

for category, severity, pattern, title, fix in PHRASES:
    PACK.add(category, severity, category, has=ci(pattern), title=title, fix=fix, better=fix,
             emits=PER_MATCH)

PACK.add("missing-security-guidance", MEDIUM, "missing-security-guidance",
         has=ci(r"create|build|implement|add|make|develop"),
         lacks=ci(r"security|auth|validation|sanitize|protect|secure"), longer_than=100, line=1,
         title="Feature request says nothing about security",
         fix="Add the security needs to the request.",
         better="Mention access, validation and error handling.")
PACK.add("missing-database-security", HIGH, "missing-database-security", owasp="A03",
         has=ci(r"database|query|insert|update|delete|find"),
         lacks=ci(r"parameterized|prepared|sanitize|orm|sequelize|prisma"), longer_than=50, line=1,
         title="Data request says nothing about safe queries",
         fix="Ask for bind parameters or a mapper.",
         better="State how queries must be built.")

for category, severity, pattern, title, fix in PHRASES:
    PACK.add(COMMENT_PREFIX + category, severity, category, has=ci(pattern),
             title="In a comment: " + title, fix=fix, better=fix, emits=COMMENT_PREFIX)
