"""Infrastructure-file rules. Severities and categories are fixed values."""

from .base import CRITICAL, HIGH, OTHER, Pack

PACK = Pack("iac", "iac-security", None)

PACK.add("docker_root", CRITICAL, "infrastructure", emits=OTHER,
         title="Container is told to run as root", fix="Switch to an unprivileged user.",
         better="Create a user in the image and select it last.")
PACK.add("curl_bash", HIGH, "infrastructure", emits=OTHER,
         title="Downloaded script is run unseen", fix="Download, check the digest, then run.",
         better="Prefer packages from a signed source.")
PACK.add("docker_implicit", HIGH, "infrastructure", emits=OTHER,
         title="Container never leaves the root user", fix="Select an unprivileged user.",
         better="Create a user in the image and select it last.")
PACK.add("gha_write_all", CRITICAL, "infrastructure", emits=OTHER,
         title="Workflow holds every write permission", fix="Grant the permissions it needs.",
         better="Start from read-only and add per job.")

# The top-level key and value of a workflow, and the text that gives its line.
WRITE_ALL_KEY, WRITE_ALL = "permissions", "write-all"
WRITE_ALL_TEXT = "permissions: write-all"
