"""Database rules. Patterns, severities and categories are fixed values."""

from .base import CRITICAL, HIGH, LOW, MEDIUM, Pack, ci

PACK = Pack("db", "database-security", "A03")
add = PACK.add

for rule_id, label, pattern in (
    ("conn_mongo", "MongoDB", r"mongodb(\+srv)?:\/\/[^:\s]+:[^@\s]+@[^\s]+"),
    ("conn_postgres", "PostgreSQL", r"postgresql:\/\/[^:\s]+:[^@\s]+@[^\s]+"),
    ("conn_mysql", "MySQL", r"mysql:\/\/[^:\s]+:[^@\s]+@[^\s]+"),
):
    add(rule_id, CRITICAL, "hardcoded-credentials", owasp="A07", has=pattern,
        title=f"{label} address contains a password",
        fix="Read the address from the environment or a vault.")
add("no_tls", HIGH, "missing-encryption", owasp="A02",
    has=r"mongoose\.connect|sequelize|knex", lacks=ci(r"ssl|tls|useSSL"),
    title="Database connection without encryption",
    fix="Turn on encryption for the connection.")
add("sql_template", CRITICAL, "sql-injection-risk",
    has=r"\.query\s*\(`.*\$\{", line=r"\.query\s*\(`",
    title="Template value inside a statement",
    fix="Use bind parameters.")
add("nosql_input", HIGH, "nosql-injection-risk",
    has=[r"\.find\s*\(|\.findOne\s*\(", r"req\.(body|params|query)"],
    title="Request data used as a document filter",
    fix="Cast and check each field of the filter.")
add("create_unchecked", MEDIUM, "missing-input-validation",
    has=[r"User\.create|Model\.create", r"req\.body"], lacks=r"sanitize|validate|pick",
    title="Record created from unchecked input",
    fix="Check the input and take only the fields you expect.")
add("schema_no_valid", MEDIUM, "missing-schema-validation", owasp="A08",
    has=ci(r"(?:new Schema|defineModel|createTable)"), lacks=r"required|validate|min|max",
    title="Schema without field constraints",
    fix="State which fields are needed and their ranges.")
add("no_unique", LOW, "missing-unique-constraint", owasp="A08",
    has=[r"email|username|phone", r"Schema|model"], lacks=r"unique:\s*true|uniqueIndex",
    title="Identifying field not declared unique",
    fix="Add a unique index.")
add("db_err_disclose", MEDIUM, "error-disclosure", owasp="A05",
    has=[r"catch.*err", r"res\.(send|json).*err"], line=r"res\.(send|json).*err",
    title="Database error passed to the client",
    fix="Log it and send a general message.")
add("unhandled_write", MEDIUM, "unhandled-promise", owasp="A09",
    has=r"(?:\.save\(\)|\.insert\(\)|\.update\(\))", lacks=r"await|\.then|\.catch",
    line=r"\.save\(\)|\.insert\(\)",
    title="Outcome of a write is ignored",
    fix="Await the write and handle its failure.")
add("no_ownership", HIGH, "missing-access-control", owasp="A01",
    has=r"findById\(req\.params\.id\)", lacks=r"userId|ownerId|belongsTo|authorize",
    title="Lookup does not check ownership",
    fix="Add the owner to the lookup condition.")
add("mass_assign", HIGH, "mass-assignment", owasp="A01",
    has=r"User\.create\(req\.body\)|\.update\(req\.body\)", line=r"User\.create\(req\.body\)",
    title="Whole request body written to a record",
    fix="Copy the permitted fields one by one.")
for rule_id, field in (
    ("plain_ssn", r"ssn"),
    ("plain_social_security", r"social.security"),
    ("plain_credit_card", r"credit.card"),
    ("plain_bank_account", r"bank.account"),
):
    add(rule_id, CRITICAL, "missing-encryption-at-rest", owasp="A02",
        has=[ci(field), ci(r"Schema|model|column")], lacks=ci(r"encrypt|hash|cipher"),
        title="Sensitive field kept in clear: " + field.replace(".", " "),
        fix="Encrypt the field before it is stored.")
