"""Counts and roll-ups over files, findings and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.glob import path_matches
from ..functions.sql import col, column

#: CI vendor by the path, relative to the project, of a file that shows it.
CI_FILES = {
    ".buildkite/pipeline.yml": "buildkite", ".circleci/config.yml": "circleci", ".gitlab-ci.yml": "gitlab", ".semaphore/semaphore.yml": "semaphore", ".travis.yml": "travisci", "appveyor.yml": "appveyor",
    "azure-pipelines.yml": "azurepipelines", "bamboo.yml": "bamboo", "bitbucket-pipelines.yml": "bitbucketpipelines", "compose.yaml": "dockercompose", "compose.yml": "dockercompose", "Containerfile": "containerfile",
    "docker-compose.yaml": "dockercompose", "docker-compose.yml": "dockercompose", "Dockerfile": "dockerfile", "Jenkinsfile": "jenkins",
}

#: (glob, kind, tool) of coding agents' files; the first that matches counts.
AGENT_FILES = [
    ("**/.claude/skills/**/SKILL.md", "skills", "claude"), ("**/skills/**/SKILL.md", "skills", "any"),
    ("CLAUDE.md", "instructions", "claude"), ("**/.codex/AGENTS.md", "instructions", "codex"), ("**/.codex/AGENTS.override.md", "instructions", "codex"), ("AGENTS.md", "instructions", "any"), ("GEMINI.md", "instructions", "gemini"),
    ("**/.cursor/rules/**", "instructions", "cursor"), (".cursorrules", "instructions", "cursor"), (".windsurfrules", "instructions", "windsurf"),
    ("**/.mcp.json", "mcp_config", "claude"), ("**/.cursor/mcp.json", "mcp_config", "cursor"),
    (".aider.conf.yml", "other", "aider"), ("**/.continue/**", "other", "continue"), ("**/.clinerules", "other", "cline"), ("**/.github/copilot-instructions.md", "other", "copilot"), ("**/.codex/config.toml", "other", "codex"),
]

MOST_TEXT = 16_384


def skipped_files(files: DataFrame, skipped: Column, with_paths: bool = False) -> DataFrame:
    """One row: how many files were skipped and, if asked, their paths in order."""
    counts = [F.count_if(skipped).alias("skipped")]
    if with_paths:
        counts.append(F.array_sort(F.collect_list(F.when(skipped, F.col("path")))).alias("paths"))
    return files.agg(*counts)


def analyzed_files(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("analyzed"), F.count_if("is_hidden").alias("hidden"))


def ci_vendors(files: DataFrame) -> DataFrame:
    """(vendor, used): 1 or 0 for each vendor that is known."""
    vendor = F.create_map(*[F.lit(x) for kv in CI_FILES.items() for x in kv])
    seen = files.select(F.try_element_at(vendor, F.col("path")).alias("vendor")).where("vendor is not null").distinct()
    known = files.sparkSession.createDataFrame([(v,) for v in sorted(set(CI_FILES.values()))], "vendor string")
    return known.join(seen.withColumn("used", F.lit(1)), "vendor", "left").select("vendor", F.coalesce("used", F.lit(0)).alias("used"))


def agent_files(files: DataFrame) -> DataFrame:
    """(kind, files, tools): for each kind of agents' files their number and the tools, sorted."""
    found = F.lit(None).cast("struct<kind:string,tool:string>")
    for glob, kind, tool in reversed(AGENT_FILES):
        found = F.when(column(path_matches(col("path"), glob)), F.struct(F.lit(kind).alias("kind"), F.lit(tool).alias("tool"))).otherwise(found)
    counted = files.select(found.alias("f")).where("f is not null").groupBy("f.kind").agg(F.count("*").alias("files"), F.concat_ws(",", F.array_sort(F.collect_set("f.tool"))).alias("tools"))
    kinds = files.sparkSession.createDataFrame([(k,) for k in sorted({k for _, k, _ in AGENT_FILES})], "kind string")
    return kinds.join(counted, "kind", "left").select("kind", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("tools", F.lit("")).alias("tools"))


STEPS = {"::preFilter": "preFilter::general", "::matcher": "matcher::general", "::postFilter": "postFilter::general"}


def durations(timings: DataFrame) -> DataFrame:
    """(id, count, total_ns, mean_us) by id, with totals of rules' steps. timings: (id, ns). As in a log of
    running totals, a rule's step enters its total once, with its sum."""
    by_id = timings.groupBy("id").agg(F.count("*").alias("count"), F.sum("ns").alias("total_ns"))
    general = F.lit(None).cast("string")
    for suffix, name in STEPS.items():
        general = F.when(F.col("id").endswith(suffix), F.lit(name)).otherwise(general)
    rolled = by_id.withColumn("id", general).where("id is not null").groupBy("id").agg(F.count("*").alias("count"), F.sum("total_ns").alias("total_ns"))
    return by_id.unionByName(rolled).withColumn("mean_us", F.round(F.col("total_ns") / 1000 / F.col("count"), 3)).orderBy(F.desc("total_ns"), "id")


def measures(numbers: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(key, num, str) under the prefix text. Numbers of a key add up, negative ones don't count; texts that
    are empty or too long are left out."""
    key = F.concat(F.lit("text."), F.col("key"))
    out = numbers.where("num >= 0").groupBy(key.alias("key")).agg(F.sum("num").cast("long").alias("num")).withColumn("str", F.lit(None).cast("string"))
    if texts is not None:
        fit = texts.where((F.length("str") > 0) & (F.length("str") <= MOST_TEXT))
        out = out.unionByName(fit.select(key.alias("key"), F.lit(None).cast("long").alias("num"), "str"))
    return out


def as_list(values: Column) -> Column:
    """A list as one text: ["a", "b"]."""
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"')))), F.lit("]"))
