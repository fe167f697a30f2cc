"""Attack technique and control of a finding's risk class."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.patterns import quoted
from ..rules.catalog import COMPLIANCE

_EXACT = "CASE owasp " + " ".join(
    f"WHEN {quoted(o)} THEN {i}" for i, (o, _, _) in enumerate(COMPLIANCE)) + " END"
_NEAR = "CASE WHEN owasp = '' THEN NULL " + " ".join(
    f"WHEN contains({quoted(o)}, owasp) OR contains(owasp, {quoted(o.split(' ')[0])}) THEN {i}"
    for i, (o, _, _) in enumerate(COMPLIANCE)) + " END"


def _named(values) -> str:
    return f"get(array({', '.join(map(quoted, values))}), _class)"


def compliance_enrich(findings: DataFrame) -> DataFrame:
    """Add `mitre` and `nist`: by the full class name, else by the first class that
    contains the reference or whose code the reference contains.

    The ten classes are constants, so this is a projection, not a join.
    """
    return findings.selectExpr("*", f"coalesce({_EXACT}, {_NEAR}) AS _class") \
        .selectExpr("* EXCEPT (_class)", f"{_named([m for _, m, _ in COMPLIANCE])} AS mitre",
                    f"{_named([n for *_, n in COMPLIANCE])} AS nist")
