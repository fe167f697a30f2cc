"""Column layout shared by all operators."""

from pyspark.sql import types as T

FILE_KEYS = ["repo_id", "path"]
FILES = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("abs_path", T.StringType()),
    T.StructField("content", T.StringType()),
])
# One hit inside a file, before the rule's own texts are added.
HIT = "struct<rule_no:int,line:bigint,match_ord:bigint,matched_text:string>"
FINDING_COLUMNS = [
    "pack", "rule_id", "finding_id", "type", "category", "severity", "title", "repo_id", "path",
    "line", "match_ord", "matched_text", "suggested_env_var", "remediation", "best_practice",
    "owasp", "package",
]
# Columns that give the report order: scan, file, rule, match.
ORDER_COLUMNS = ["pack_ord", "rule_ord"]
