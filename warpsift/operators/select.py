"""Which files each pack looks at. Globs are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.globs import any_glob
from ..functions.patterns import quoted

JS = "**/*.{js,ts,jsx,tsx}"
VENDORED = ("node_modules/**", ".git/**")
BUILT = (*VENDORED, "dist/**", "build/**")

# pack -> [(globs, ignored globs)]; a file is selected if any entry takes it.
SELECTORS = {
    "owasp": [(("**/*.js", "**/*.ts", "**/*.jsx", "**/*.tsx", "**/*.py", "**/*.rb", "**/*.php",
                "**/*.java", "**/*.go"), (*BUILT, "test/**", "tests/**"))],
    "auth": [(("**/*auth*", "**/*login*", "**/*register*", "**/*session*", "**/*token*",
               "**/*middleware*", "**/*route*", "**/app.js", "**/server.js", "**/index.js"),
              VENDORED)],
    "db": [(("**/*database*", "**/*db*", "**/*model*", "**/*schema*", "**/*migration*",
             "**/ormconfig*", "**/.env*", "**/config/*", "**/*.sql"), VENDORED),
           ((JS,), BUILT)],
    "api": [(("**/*api*", "**/*route*", "**/*controller*", "**/*endpoint*", "**/routes/**",
              "**/controllers/**"), VENDORED)],
    "headers": [((JS, "**/app.*", "**/server.*", "**/index.*"), BUILT)],
    "upload": [((JS, "**/*upload*", "**/*file*", "**/*multipart*"), BUILT)],
    "webhook": [((JS, "**/*webhook*", "**/*stripe*", "**/*payment*", "**/callback*"), BUILT)],
    "ratelimit": [((JS, "**/*route*", "**/*api*", "**/*controller*"), BUILT)],
    "env": [(("**/*.{js,ts,jsx,tsx,py,rb,go}",), (*BUILT, "*.test.*", "*.spec.*"))],
    "prompts": [(("**/*.md", "**/prompts/**/*", "**/.cursorrules", "**/.clinerules",
                  "**/.windsurfrc", "**/.github/copilot-instructions.md", "**/*.prompt",
                  "**/PROMPT*", "**/instructions*"), BUILT)],
    "comments": [((JS,), BUILT)],
    "routes": [((JS,), BUILT)],
    "dockerfiles": [(("**/Dockerfile*",), VENDORED)],
    "workflows": [((".github/workflows/*.{yml,yaml}",), ())],
    # Our own choice: every file, dot files included.
    "secrets": [(("**/*", "**/.*"), BUILT)],
}
SELECTORS["matrix"] = SELECTORS["owasp"]
# Path texts the route rule leaves out.
ROUTE_SKIP = ("src/scanners/", "src/autofix/")


def selected(selector: str, path: str = "path") -> str:
    """SQL test: does the selector take this path?"""
    taken = []
    for globs, ignored in SELECTORS[selector]:
        test = f"{path} RLIKE {quoted(any_glob(globs))}"
        if ignored:
            test += f" AND NOT {path} RLIKE {quoted(any_glob(ignored, dot=True))}"
        taken.append(f"({test})")
    tests = ["(" + " OR ".join(taken) + ")"]
    if selector == "routes":
        tests += [f"NOT contains({path}, '{text}')" for text in ROUTE_SKIP]
    if selector == "env":
        tests.append(f"NOT startswith({path}, '.env')")
    return "(" + " AND ".join(tests) + ")"


def select_files(files: DataFrame, selector: str) -> DataFrame:
    return files.where(selected(selector))


def ignore_paths(files: DataFrame, globs) -> DataFrame:
    """Drop files that match any of the user's ignore globs (list or comma list)."""
    globs = [g.strip() for g in (globs.split(",") if isinstance(globs, str) else globs)]
    globs = [g for g in globs if g]
    return files.where(~F.col("path").rlike(any_glob(globs, dot=True))) if globs else files


def selector_counts(files: DataFrame) -> DataFrame:
    """Files per selector, in one pass."""
    counted = files.selectExpr(*[f"count_if({selected(n)}) AS {n}" for n in SELECTORS])
    pairs = ", ".join(f"named_struct('selector', '{n}', 'files', {n})" for n in SELECTORS)
    return counted.selectExpr(f"inline(array({pairs}))")
