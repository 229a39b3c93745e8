"""Files of a tree: listings without content, patterns, kinds, projects and manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no sources, and the kinds of files by what ends their path.
IGNORED = (".git", ".svn", ".hg", ".idea", ".vscode", "node_modules", "temp", "tmp", "1Cv8", "1Cv8Log")
KINDS = (
    (r"/Ext/ObjectModule\.bsl$", "object module"), (r"/Ext/ManagerModule\.bsl$", "manager module"), (r"/Ext/RecordSetModule\.bsl$", "record set module"), (r"/Ext/CommandModule\.bsl$", "command module"),
    (r"/Ext/Form/Module\.bsl$", "form module"), (r"(^|/)CommonModules/[^/]+/Ext/Module\.bsl$", "common module"), (r"\.bsl$", "module"), (r"/Ext/Form\.xml$", "form"), (r"/Ext/Rights\.xml$", "rights"),
    (r"/Ext/Predefined\.xml$", "predefined"), (r"(^|/)Configuration\.xml$", "configuration"), (r"\.xml$", "object"),
)


def glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: ``**/`` any folders, ``*`` and ``?`` within a name."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def matches(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def chosen(listing: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows of a listing (``path``) that an include pattern matches, no exclude pattern and no ignored folder."""
    ignored = F.exists(F.split("path", "/"), lambda x: x.isin(*IGNORED))
    return listing.where(matches(F.col("path"), include or ["**"]) & ~matches(F.col("path"), exclude) & ~ignored)


def tree(spark: SparkSession, root: str, include: list[str], exclude: list[str]) -> DataFrame:
    """``path`` (below the root), ``length``, ``modificationTime``; contents are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    below = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")) + "/", "")
    return chosen(found.withColumn("path", below), include, exclude)


def kind(path: Column) -> Column:
    """The kind of a file by its path."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, name in KINDS:
        out = out.when(path.rlike(pattern), name)
    return out.otherwise("other")


def projects(listing: DataFrame, depth: int = 3) -> DataFrame:
    """``folder``, ``files``: folders up to ``depth`` levels down that hold code somewhere below."""
    parts = F.split("path", "/")
    rows = chosen(listing, [], []).select("path", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.greatest(F.lit(1), F.size(parts) - 1)))).alias("level"))
    folder = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("level")), "/")
    return rows.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.bool_or(F.col("path").endswith(".bsl")).alias("code")).where("code").drop("code")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``name, root, kind, finding`` of the components of a manifest; ``finding`` is null for a sound one.

    A component needs a name that no other has, a root that stays below the manifest, and a known kind.
    """
    schema = "version int, components array<struct<name: string, root: string, kind: string, applyOrder: int>>"
    c = spark.read.schema(schema).option("multiLine", True).json(path).select("version", F.inline("components"))
    n = c.groupBy(F.col("name").alias("_name")).agg(F.count("*").alias("_n"))
    finding = (
        F.when(F.col("version").isNull(), "version is missing").when(F.coalesce(F.trim("name"), F.lit("")) == "", "name is missing").when(F.col("_n") > 1, "name is not unique")
        .when(F.coalesce("root", F.lit("/")).rlike(r"(^|/)\.\.(/|$)|^/"), "root leaves the folder").when(~F.coalesce("kind", F.lit("")).isin("configuration", "extension", "processor"), "kind is not known")
    )
    return c.join(n, F.col("name").eqNullSafe(F.col("_name"))).select("name", "root", "kind", finding.alias("finding"))
