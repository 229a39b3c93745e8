"""Facts of a code base, bound to the input tables: modules, symbols, calls, accesses, grants, texts.

``SQL`` has the same bindings as common table expressions; ``with_facts`` puts those that a query names in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SMALL, kept, side
from .tables import table

SQL = {
    "modules": "SELECT DISTINCT p_size AS module, 'm' || p_size AS name, 'src/m' || p_size || '/Module.bsl' AS file, CASE WHEN p_size < 25 THEN p_size END AS owner, CASE p_size % 3 WHEN 0 THEN 'common' WHEN 1 THEN 'object' ELSE 'form' END AS kind FROM part",
    "symbols": "SELECT p_partkey AS symbol, p_name AS name, lower(p_name) AS norm, p_type AS kind, p_brand AS component, p_size AS module, p_retailprice >= 905 AS exported FROM part",
    "calls": "SELECT a.l_partkey AS caller, b.l_partkey AS callee, a.l_returnflag AS kind, CASE WHEN a.l_linestatus = 'F' THEN 'resolved' ELSE 'dynamic' END AS resolution, round(1 - a.l_discount, 2) AS confidence, a.l_orderkey AS file, a.l_linenumber AS line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1",
    "accesses": "SELECT l_partkey AS symbol, l_suppkey AS register, CASE l_returnflag WHEN 'A' THEN 'read' WHEN 'N' THEN 'write' ELSE 'clear' END AS mode, l_linestatus = 'F' AS static, round(1 - l_discount, 2) AS confidence FROM lineitem",
    "grants": "SELECT c_mktsegment AS role, o_orderpriority AS object, o_orderstatus AS name, o_totalprice > 100000 AS value, c_acctbal < 0 AS restricted FROM orders JOIN customer ON o_custkey = c_custkey",
}


def with_facts(sql: str) -> str:
    """``sql`` behind the bindings that it names, each as a common table expression."""
    named = [n for n in SQL if f" {n}" in sql or f"\n{n}" in sql or f"({n}" in sql]
    before = ", ".join(f"{n} AS ({SQL[n]})" for n in named)
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {before}, {sql.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {before}, {sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f"WITH {before} {sql}"


def modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules: module, name, file, owner (nullable), kind."""
    m = F.col("module")
    kind = F.when(m % 3 == 0, "common").when(m % 3 == 1, "object").otherwise("form")
    found = table(spark, d, "part").select(F.col("p_size").alias("module")).distinct()
    return found.select("module", F.concat(F.lit("m"), m).alias("name"), F.concat(F.lit("src/m"), m, F.lit("/Module.bsl")).alias("file"), F.when(m < 25, m).alias("owner"), kind.alias("kind"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols: symbol, name, norm, kind, component, module, exported."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name"), F.lower("p_name").alias("norm"), F.col("p_type").alias("kind"), F.col("p_brand").alias("component"), F.col("p_size").alias("module"), (F.col("p_retailprice") >= 905).alias("exported"))


def calls(spark: SparkSession, d: str, callers: DataFrame | None = None, callees: DataFrame | None = None) -> DataFrame:
    """Calls between symbols: the parts of neighbouring lines of an order.

    Given tables of ``callers`` (one column ``caller``) or ``callees``, only their lines meet others.
    """
    li = table(spark, d, "lineitem")
    after = li.select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") - 1).alias("line"), F.col("l_partkey").alias("callee"))
    own = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("caller"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_linestatus") == "F", "resolved").otherwise("dynamic").alias("resolution"), F.round(1 - F.col("l_discount"), 2).alias("confidence"))
    # the lines of some symbols are counted: where they are few no others are shuffled, and many are not left to Spark's size of their file
    few = lambda df: side(df, n) if (n := df.count()) <= SMALL else df.hint("merge")
    own = own if callers is None else few(kept(own.join(callers, "caller", "left_semi")))
    after = after if callees is None else few(kept(after.join(callees, "callee", "left_semi")))
    return own.join(after, ["file", "line"]).select("caller", "callee", "kind", "resolution", "confidence", "file", "line")


def accesses(spark: SparkSession, d: str) -> DataFrame:
    """Register accesses of symbols: symbol, register, mode, static, confidence."""
    mode = F.when(F.col("l_returnflag") == "A", "read").when(F.col("l_returnflag") == "N", "write").otherwise("clear")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("register"), mode.alias("mode"), (F.col("l_linestatus") == "F").alias("static"), F.round(1 - F.col("l_discount"), 2).alias("confidence"))


def grants(spark: SparkSession, d: str) -> DataFrame:
    """Rights that roles grant on objects: role, object, name, value, restricted."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_mktsegment").alias("role"), F.col("o_orderpriority").alias("object"), F.col("o_orderstatus").alias("name"), (F.col("o_totalprice") > 100000).alias("value"), (F.col("c_acctbal") < 0).alias("restricted"))
