"""Calls matched with path templates and hosts with host rules, by equality joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def _open(segment: Column) -> Column:
    return segment.startswith("{")


def matched_templates(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``id``, ``endpoint``: the best template for each call's path, null if there is none.

    ``calls`` have ``id`` and ``url``, ``endpoints`` have ``endpoint`` and ``pattern``. ``{name}``
    stands for any segment, a last ``*`` for any number. More literal segments win, then templates
    without ``*``, then the smaller name. Templates are few shapes (which segments are literal);
    a call takes one key per shape, so both sides meet by equality and never all with all. If both
    have a ``verb``, it must be the same, or ``*`` for the template.
    """
    verb = ["verb"] if "verb" in endpoints.columns and "verb" in calls.columns else []
    e = endpoints.select("endpoint", *verb, text.segments(F.col("pattern")).alias("s"))
    e = e.withColumn("tail", F.coalesce(F.get("s", F.size("s") - 1) == "*", F.lit(False)))
    e = e.withColumn("s", F.when(F.col("tail"), F.slice("s", F.lit(1), F.size("s") - 1)).otherwise(F.col("s")))
    literal = F.filter("s", lambda x: ~_open(x))
    shape = F.concat_ws("", F.transform("s", lambda x: F.when(_open(x), "0").otherwise("1")))
    e = e.select("endpoint", *verb, "tail", F.size("s").alias("depth"), shape.alias("shape"), F.concat_ws("/", literal).alias("key"), F.size(literal).alias("literals"))
    c = calls.select("id", *[F.explode(F.array("verb", F.lit("*"))).alias("verb") for _ in verb], text.segments(F.col("url")).alias("c"))
    c = c.select("id", *verb, "c", F.explode(F.sequence(F.lit(0), F.size("c"))).alias("depth"))
    c = c.join(e.select("depth", "shape", "tail").distinct(), "depth").where(F.col("tail") | (F.col("depth") == F.size("c")))
    head = F.slice("c", F.lit(1), F.col("depth"))
    c = c.withColumn("key", F.concat_ws("/", F.filter(head, lambda x, i: F.substring("shape", i + 1, F.lit(1)) == "1")))
    best = c.join(e, ["depth", "shape", "tail", "key", *verb]).groupBy("id").agg(F.min(F.struct((-F.col("literals")).alias("n"), "tail", "endpoint")).alias("m"))
    return calls.select("id").join(best, "id", "left").select("id", F.col("m.endpoint").alias("endpoint"))


def mapped_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``project``: an exact rule, else the one with the longest ``*suffix``, else null.

    ``hosts`` have ``host``, ``rules`` have ``rule`` and ``project``. Every end of a distinct host
    is looked up, so suffix rules join by equality too.
    """
    h = hosts.select("host").distinct()
    ends = h.select("host", F.explode(F.sequence(F.lit(0), F.length("host"))).alias("at"))
    ends = ends.select("host", F.expr("substring(host, at + 1)").alias("end"), (F.lit(1) + F.col("at")).alias("order"), F.lit(True).alias("suffix"))
    asked = ends.unionByName(h.select("host", F.col("host").alias("end"), F.lit(0).alias("order"), F.lit(False).alias("suffix")))
    r = rules.select(F.ltrim(F.col("rule"), F.lit("*")).alias("end"), F.col("rule").startswith("*").alias("suffix"), "project")
    best = asked.join(r, ["end", "suffix"]).groupBy("host").agg(F.min(F.struct("order", "project")).alias("m"))
    return h.join(best, "host", "left").select("host", F.col("m.project").alias("project"))
