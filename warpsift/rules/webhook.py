"""Webhook rules. Patterns, severities and categories are fixed values."""

from .base import CRITICAL, HIGH, LOW, MEDIUM, Pack, ci

PACK = Pack("webhook", "webhook-security", "A01")
add = PACK.add

add("no_signature", CRITICAL, "missing-signature-verification",
    has=[r"stripe|webhook", ci(r"endpoint|route|post")],
    lacks=ci(r"stripe\.webhooks\.constructEvent|verifySignature|signature|sig_header"),
    line=r"webhook|endpoint",
    title="Incoming calls are not authenticated by signature",
    fix="Verify the sender's signature over the raw body.", better="Reject before parsing.")
add("no_auth", HIGH, "unprotected-webhook",
    path=r"webhook|callback", lacks=ci(r"auth|verify|signature|token|secret"),
    line=r"webhook|callback",
    title="Callback file has no protection at all",
    fix="Require a shared secret or a signature.", better="Rotate the secret.")
add("no_replay", MEDIUM, "missing-replay-protection",
    has=r"webhook|stripe", lacks=ci(r"timestamp|nonce|replay|idempotency"), line=r"webhook",
    title="Old calls can be sent again",
    fix="Refuse calls with an old time stamp.", better="Remember recent call ids.")
add("no_idempotency", MEDIUM, "missing-idempotency", owasp="A04",
    has=r"webhook.*event|stripe.*event", lacks=ci(r"idempotency|processed.*before|duplicate"),
    line=r"webhook.*event",
    title="Repeated events are processed again",
    fix="Record event ids and skip known ones.", better="Make handlers repeatable.")
add("bad_ack", LOW, "improper-response", owasp="A04",
    has=r"webhook", lacks=ci(r"200|send.*OK|json.*success"),
    title="Receipt is not confirmed",
    fix="Answer with status 200 at once.", better="Confirm first, work later.")
add("err_disclosure", MEDIUM, "error-disclosure", owasp="A05",
    has=[r"webhook", ci(r"catch.*err.*res\.send.*err|res\.json.*error.*stack")],
    line=r"catch.*err",
    title="Sender receives internal errors",
    fix="Log the error and answer briefly.", better="Senders need a status only.")
add("sync_processing", LOW, "synchronous-processing", owasp="A04",
    has=[r"webhook", ci(r"database|api.*call|external")],
    lacks=ci(r"timeout|async|queue|background"),
    title="Slow work is done while the sender waits",
    fix="Queue the event and answer.", better="Keep the handler short.")
