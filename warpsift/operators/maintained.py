"""Findings kept up to date under changes: what did not change is neither read nor tested again.

The state is four tables under one folder. Every batch of changes is a generation and writes one
folder in each of them, so a batch that failed and is repeated replaces what it wrote:

* `tree`: for each changed file the hash of its text and its profile, or nulls if it is gone. The
  profile holds the outcome of every selector and path test of the catalog, so the hits of a file
  follow from text and profile alone.
* `hits`: the hits of each text and profile, found once, whatever files hold that text, when and
  where: moved, copied and restored files cost no scan. The folder is named by the catalog.
* `changes`: findings that came (+1) and went (-1). A batch compares the hits of the old and the
  new text of each changed file; what both have cancels out.
* `counts`: the same as differences per repository and severity; grades are sums of them.

The tables lie in a folder named by the catalog: other rules are another state.

A generation counts once it is named in `done`, written last. Reads of older state are pruned to
the folders of the files, or of the hashes, that a batch touches. `compacted` writes the state
into a new folder as one generation; the old one is its owner's to remove.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.patterns import flagged, quoted
from ..rules.catalog import rules_of
from ..schema import HIT
from ..sources.files import in_folders, part_of
from .joins import fits_broadcast, lookup_join
from .reports import grade_of
from .scan import finding_rows, rule_table, scan_files, selectors_of
from .select import selected

BUCKETS = 64
_ONE = "rule_no int, line bigint, match_ord bigint, matched_text string"
SCHEMAS = {
    "tree": "repo_id bigint, path string, mark binary, profile string, repo_part int",
    "hits": f"mark binary, profile string, hits array<{HIT}>, bucket int",
    "changes": f"repo_id bigint, path string, {_ONE}, sign bigint, repo_part int",
    "counts": "repo_id bigint, severity string, n bigint",
    "done": "n_changes bigint",
}
_FOLDERS = {"tree": ["repo_part"], "hits": ["bucket"], "changes": ["repo_part"]}
_KEY = ["repo_id", "path"]
_TEXT = ["bucket", "mark", "profile"]


def _bucket():
    return F.pmod(F.xxhash64("mark"), F.lit(BUCKETS)).cast("int").alias("bucket")


class MaintainedFindings:
    """The findings of some packs (not `env`, which judges whole repositories)."""

    def __init__(self, spark: SparkSession, root: str, packs, extra_rules=()):
        if {"env", "deps"} & set(packs):
            raise ValueError("packs that judge whole repositories are not kept by file")
        self.spark, self.root = spark, root.rstrip("/")
        self.packs, self.extra = list(packs), tuple(extra_rules)
        rules = rules_of(self.packs, self.extra)
        self.catalog = hashlib.sha256(repr(rules).encode()).hexdigest()[:16]
        selectors = sorted({s for r in rules for s in selectors_of(r)} | (
            {"comments"} if "prompts" in self.packs else set()))
        paths = dict.fromkeys(p for r in rules for p in (*r.path_all, *r.path_none))
        tests = [selected(s) for s in selectors]
        tests += [f"abs_path RLIKE {quoted(flagged(p))}" for p in paths]
        self._profile = "concat(" + ", ".join(
            f"CASE WHEN {t} THEN '1' ELSE '0' END" for t in tests) + ")"
        self._chosen = " OR ".join(tests[:len(selectors)])
        self._looked_at = "'1' IN (" + ", ".join(
            f"substr(profile, {i + 1}, 1)" for i in range(len(selectors))) + ")"

    # ---- tables -------------------------------------------------------------------------

    def _folder(self, table: str) -> str:
        return f"{self.root}/{self.catalog}/{table}"

    def _read(self, table: str, before: int | None = None) -> DataFrame:
        """A table's rows of all finished generations, or of those before one."""
        if before is None:
            before = self.last() + 1
        return self.spark.read.schema(f"{SCHEMAS[table]}, gen int").parquet(
            self._folder(table)).where(F.col("gen") < before)

    def _write(self, df: DataFrame, table: str, gen: int) -> DataFrame:
        path, folders = f"{self._folder(table)}/gen={gen}", _FOLDERS.get(table, [])
        # Dealt out by folder, large folders over several tasks: else every task would write a
        # file into every folder.
        dealt = df.hint("rebalance", *folders)
        dealt.write.mode("overwrite").partitionBy(*folders).parquet(path)
        return self.spark.read.schema(SCHEMAS[table]).parquet(path)

    def start(self) -> MaintainedFindings:
        """An empty state in a new folder."""
        for table, schema in SCHEMAS.items():
            self._write(self.spark.createDataFrame([], schema), table, -1)
        self._finish(0, 0)
        return self

    def _finish(self, gen: int, n: int) -> None:
        self._write(self.spark.range(1).select(F.lit(n).cast("long").alias("n_changes")), "done",
                    gen)

    def last(self) -> int:
        """The newest finished generation (one row per generation is read)."""
        return self.spark.read.schema(f"{SCHEMAS['done']}, gen int").parquet(
            self._folder("done")).agg(F.max("gen")).first()[0]

    # ---- a batch of changes -------------------------------------------------------------

    def apply(self, changes: DataFrame, gen: int | None = None) -> int:
        """Take in changed files: `repo_id, path, abs_path, op, content`, one row per file.

        `op` D removes a file, any other letter puts its text in. A batch that is repeated after
        a failure gives its number again. Returns the number of the generation.
        """
        gen = self.last() + 1 if gen is None else gen
        gone = F.col("op") == "D"
        keyed = changes.select(
            *_KEY, F.when(~gone, F.unhex(F.md5(F.coalesce("content", F.lit(""))))).alias("mark"),
            F.when(~gone, F.expr(self._profile)).alias("profile"), part_of().alias("repo_part"))
        tree = self._write(keyed, "tree", gen)
        wanted = tree.where(f"mark IS NOT NULL AND {self._looked_at}").groupBy(
            _bucket(), "mark", "profile").agg(F.min(F.struct(*_KEY)).alias("first"))
        known = self._touched(self._read("hits", gen), wanted, ["bucket"]).select(*_TEXT)
        unseen = wanted.join(known, _TEXT, "left_anti").select("first.*")
        texts = changes.where(~gone)
        if fits_broadcast(unseen):
            # One file of each new text. Beyond the bound nearly all is new, as in the first
            # batch: every text is tested where it lies, and equal results are dropped.
            texts = texts.join(F.broadcast(unseen), _KEY, "left_semi")
        # The selectors' own tests: a test of the profile would repeat it once per selector.
        scanned = scan_files(texts.where(self._chosen), self.packs, self.extra).select(
            F.unhex(F.md5(F.coalesce("content", F.lit("")))).alias("mark"),
            F.expr(self._profile).alias("profile"), "hits")
        found = scanned.withColumn("bucket", _bucket()).dropDuplicates(_TEXT)
        self._write(found.select("mark", "profile", "hits", "bucket"), "hits", gen)

        before = self._touched(self._read("tree", gen), tree, ["repo_part", *_KEY]).groupBy(
            "repo_part", *_KEY).agg(F.max_by(F.struct("mark", "profile"), "gen").alias("was"))
        sides = before.select("repo_part", *_KEY, "was.*", F.lit(-1).alias("sign")).unionByName(
            tree.select("repo_part", *_KEY, "mark", "profile", F.lit(1).alias("sign")))
        delta = self._exploded(sides.where("mark IS NOT NULL"), gen + 1, "sign").groupBy(
            "repo_part", *_KEY, "rule_no", "line", "match_ord", "matched_text").agg(
            F.sum("sign").alias("sign")).where("sign != 0")
        delta = self._write(delta.select(*_KEY, "rule_no", "line", "match_ord", "matched_text",
                                         "sign", "repo_part"), "changes", gen)
        rules = self._rules().select("rule_no", "severity")
        self._write(delta.join(F.broadcast(rules), "rule_no").groupBy("repo_id", "severity").agg(
            F.sum("sign").alias("n")).where("n != 0"), "counts", gen)
        self._finish(gen, tree.count())
        return gen

    def _touched(self, table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
        """Rows of a state table with one of the keys, from the folders of those keys only."""
        near = in_folders(table, keys, on[0])
        return near if len(on) == 1 else lookup_join(near, keys.select(*on).distinct(), on,
                                                     "left_semi")

    def _exploded(self, files: DataFrame, before: int, *keep: str) -> DataFrame:
        """The hits of files that are given by text and profile."""
        files = files.where(self._looked_at).withColumn("bucket", _bucket())
        keys = files.select(*_TEXT).distinct()
        hits = self._touched(self._read("hits", before).drop("gen"), keys, _TEXT) \
            .dropDuplicates(_TEXT)
        return lookup_join(files, hits, _TEXT).select(
            "repo_part", *_KEY, *keep, F.explode("hits").alias("h")).select(
            "repo_part", *_KEY, *keep, "h.*")

    # ---- what is known ------------------------------------------------------------------

    def _rules(self) -> DataFrame:
        return rule_table(self.spark, self.packs, self.extra)

    def findings(self) -> DataFrame:
        """All findings as of the newest generation."""
        one = [*_KEY, "rule_no", "line", "match_ord", "matched_text"]
        live = self._read("changes").groupBy(*one).agg(F.sum("sign").alias("n")).where("n > 0")
        return finding_rows(live.select(*one), self._rules())

    def files(self) -> DataFrame:
        """The files as of the newest generation."""
        newest = self._read("tree").groupBy("repo_part", *_KEY).agg(
            F.max_by(F.struct("mark", "profile"), "gen").alias("is"))
        return newest.select(*_KEY, "is.mark", "is.profile", "repo_part").where("mark IS NOT NULL")

    def counts(self) -> DataFrame:
        """Findings per repository and severity, from the differences alone."""
        return self._read("counts").groupBy("repo_id", "severity").agg(
            F.sum("n").alias("findings")).where("findings != 0")

    def grades(self) -> DataFrame:
        """The grade of every repository that has a file."""
        totals = self.counts().groupBy("repo_id").agg(F.sum("findings").alias("total"))
        return self.files().select("repo_id").distinct().join(totals, "repo_id", "left").select(
            "repo_id", F.coalesce("total", F.lit(0)).cast("bigint").alias("total")).select(
            "repo_id", "total", grade_of("total").alias("grade"))

    def compacted(self, root: str) -> MaintainedFindings:
        """The same state in a new folder, as one generation."""
        new = MaintainedFindings(self.spark, root, self.packs, self.extra).start()
        new._write(self.files(), "tree", 1)
        live = self._read("hits").drop("gen").dropDuplicates(_TEXT)
        new._write(live, "hits", 1)
        one = [*_KEY, "rule_no", "line", "match_ord", "matched_text", "repo_part"]
        new._write(self._read("changes").groupBy(*one).agg(F.sum("sign").alias("sign")).where(
            "sign != 0").select(*one[:-1], "sign", "repo_part"), "changes", 1)
        new._write(self.counts().select("repo_id", "severity", F.col("findings").alias("n")),
                   "counts", 1)
        new._finish(1, 0)
        return new
