"""Authentication rules. Patterns, severities and categories are fixed values."""

from .base import CRITICAL, HIGH, MEDIUM, Pack, ci

PACK = Pack("auth", "authentication", "A07")
add = PACK.add

add("jwt_none", CRITICAL, "jwt-algorithm",
    has=[r"jwt\.sign", ci(r"algorithm.*none")], line=ci(r"algorithm.*none"),
    title="Token signed without an algorithm",
    fix="Name a strong signing algorithm and refuse unsigned tokens.")
add("jwt_no_expiry", HIGH, "jwt-no-expiry",
    has=r"jwt\.sign", lacks=r"expiresIn|exp:",
    title="Token never expires",
    fix="Give each token a short life.")
add("jwt_sensitive", HIGH, "jwt-sensitive-data",
    has=ci(r"jwt\.sign.*password|jwt\.sign.*secret"), line=r"jwt\.sign",
    title="Token payload holds a secret",
    fix="Put only an identifier into the payload.")
add("jwt_no_verify", CRITICAL, "missing-jwt-verification",
    has=r"jwt\.sign", lacks=r"jwt\.verify",
    title="Tokens are issued but not verified here",
    fix="Verify the signature of each incoming token.")
add("cookie_insecure", HIGH, "insecure-cookie",
    has=r"express-session|cookie-session", lacks=r"secure:\s*true",
    title="Session cookie may travel unencrypted",
    fix="Mark the cookie as secure.")
add("cookie_httponly", HIGH, "cookie-not-httponly",
    has=r"express-session|cookie-session", lacks=r"httpOnly:\s*true",
    title="Session cookie readable by scripts",
    fix="Mark the cookie as httpOnly.")
add("session_fixation", MEDIUM, "session-fixation",
    has=ci(r"login|authenticate"), lacks=r"req\.session\.regenerate",
    title="Session id survives sign-in",
    fix="Issue a new session id after sign-in.")
add("pwd_policy", MEDIUM, "weak-password-policy",
    has=ci(r"(?:register|signup|createUser)"), lacks=r"password.*length|minLength|maxLength",
    title="No password length rule at sign-up",
    fix="Demand a minimum length and refuse leaked passwords.")
add("pwd_plaintext", CRITICAL, "plaintext-password",
    has=r"(?:password|pwd)\s*[=:]\s*req\.body", lacks=r"hash|bcrypt|argon|scrypt",
    line=r"password|pwd",
    title="Password taken over unhashed",
    fix="Hash the password before it is kept.")
add("auth_no_rate", MEDIUM, "missing-rate-limiting",
    has=[ci(r"(?:login|signin|auth|register)"), r"app\.(post|get)|router\.(post|get)"],
    lacks=r"rate[-_]?limit|express-rate-limit", line=ci(r"login|auth|register"),
    title="Sign-in route without a rate limit",
    fix="Limit attempts per account and per address.")
add("csrf", MEDIUM, "missing-csrf-protection", owasp="A01",
    has=r"(?:app\.post|router\.post)", lacks=ci(r"csrf|csurf|anti-forgery|x-csrf-token"),
    path_lacks=r"api\/|\/api", line=r"app\.post|router\.post",
    title="Form route without forgery protection",
    fix="Require a forgery token on each state change.")
add("oauth_state", HIGH, "oauth-missing-state",
    has=ci(r"(?:passport|oauth|google-auth|github-auth)"), lacks=r"state:",
    line=ci(r"passport|oauth"),
    title="Delegated sign-in without a state value",
    fix="Send a random state value and compare it on return.")
