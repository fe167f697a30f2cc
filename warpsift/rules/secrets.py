"""Secret rules. Patterns are fixed values shared with the threat matrix."""

from .base import CRITICAL, PER_MATCH, Pack

PACK = Pack("secrets", "hardcoded-secret", "A07")
for rule_id, label, pattern, env_var in (
    ("aws_key", "Cloud access key", r"(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}", "AWS_ACCESS_KEY_ID"),
    ("stripe_key", "Payment secret key", r"sk_live_[0-9a-zA-Z]{24}", "STRIPE_SECRET_KEY"),
    ("mongo_uri", "Database address with password",
     r"mongodb(\+srv)?:\/\/[^:\s]+:[^@\s]+@[^\s]+", "MONGODB_URI"),
    ("github_token", "Code-host token", r"ghp_[A-Za-z0-9_]{36}", "GITHUB_TOKEN"),
):
    PACK.add(rule_id, CRITICAL, "secrets", has=pattern, env_var=env_var, emits=PER_MATCH,
             title=f"{label} in a file",
             fix=f"Revoke it and read {env_var} from the environment.")
