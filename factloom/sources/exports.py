"""Readers of an application export: XML files below a folder, read by Spark's own XML source.

Every reader takes the export's root and lists it recursively; namespaces are ignored and files
that don't parse give no rows. Nested lists are exploded, so results are flat fact tables. Forms
and predefined items nest to any depth; those files are read whole, each by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of objects and the lists of members that they may have.
KINDS = "Catalog Document Enum Constant CommonModule InformationRegister AccumulationRegister AccountingRegister CalculationRegister Report DataProcessor Role ExchangePlan".split()
MEMBERS = "Attribute Dimension Resource TabularSection EnumValue Command".split()

_NAMED = "Name: string, Synonym: struct<item: array<struct<lang: string, content: string>>>"
_TYPED = "array<struct<Properties: struct<Name: string, Type: struct<Type: array<string>>>>>"


def _read(spark: SparkSession, root: str, row: str, schema: str, name: str = "*.xml") -> DataFrame:
    files = spark.read.format("xml").schema(schema).option("rowTag", row).option("ignoreNamespace", True).option("mode", "DROPMALFORMED")
    return files.option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).withColumn("path", F.col("_metadata.file_path"))


def _plain(type_name: Column) -> Column:
    """A type without the prefix of its namespace, which differs between exports."""
    return F.regexp_replace(F.trim(type_name), "^[^:]*:", "")


def objects(spark: SparkSession, root: str) -> DataFrame:
    """Objects: kind, name, synonym (the first), path, children (struct of lists)."""
    children = ", ".join(f"{m}: {_TYPED}" for m in MEMBERS)
    schema = ", ".join(f"{k} struct<Properties: struct<{_NAMED}>, ChildObjects: struct<{children}>>" for k in KINDS)
    found = _read(spark, root, "MetaDataObject", schema)
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("o")) for k in KINDS])
    rows = found.select("path", F.explode(F.filter(each, lambda x: x["o"].isNotNull())).alias("x"))
    p = F.col("x.o.Properties")
    return rows.select(F.col("x.kind").alias("kind"), p["Name"].alias("name"), F.get(p["Synonym"]["item"], F.lit(0))["content"].alias("synonym"), "path", F.col("x.o.ChildObjects").alias("children"))


def members(found: DataFrame) -> DataFrame:
    """Members of ``objects``: kind, object, member_kind, member, types."""

    def of(m: str) -> Column:
        row = lambda x: F.struct(F.lit(m).alias("member_kind"), x["Properties"]["Name"].alias("member"), F.transform(F.coalesce(x["Properties"]["Type"]["Type"], F.array()), _plain).alias("types"))
        return F.transform(F.coalesce(F.col(f"children.{m}"), F.array()), row)

    each = F.flatten(F.array(*[of(m) for m in MEMBERS]))
    return found.where("children IS NOT NULL").select("kind", F.col("name").alias("object"), F.inline(each))


def rights(spark: SparkSession, root: str) -> DataFrame:
    """Rights: role, for_new, object, right, value, restricted. The role is named by its folder."""
    schema = "setForNewObjects string, object array<struct<name: string, right: array<struct<name: string, value: string, restrictionByCondition: array<struct<condition: string, field: array<string>>>>>>>"
    found = _read(spark, root, "Rights", schema, "Rights.xml")
    role = F.regexp_extract("path", "([^/]+)/Ext/[^/]+$", 1)
    each = found.select(role.alias("role"), (F.col("setForNewObjects") == "true").alias("for_new"), F.explode("object").alias("o"))
    each = each.select("role", "for_new", F.col("o.name").alias("object"), F.explode("o.right").alias("r"))
    ruled = F.exists(F.coalesce(F.col("r.restrictionByCondition"), F.array()), lambda x: (F.trim(F.coalesce(x["condition"], F.lit(""))) != "") | (F.size(F.coalesce(x["field"], F.array())) > 0))
    return each.select("role", F.coalesce("for_new", F.lit(False)).alias("for_new"), "object", F.col("r.name").alias("right"), (F.col("r.value") == "true").alias("value"), ruled.alias("restricted"))


def subscriptions(spark: SparkSession, root: str) -> DataFrame:
    """Event subscriptions by source: name, event, handler, source_kind (type, defined, kind), source."""
    props = "Name: string, Event: string, Handler: string, Source: struct<Type: array<string>, TypeSet: array<string>>"
    p = F.col("EventSubscription.Properties")
    found = _read(spark, root, "MetaDataObject", f"EventSubscription struct<Properties: struct<{props}>>").where(p.isNotNull())
    types = F.transform(F.coalesce(p["Source"]["Type"], F.array()), lambda x: F.struct(F.lit("type").alias("source_kind"), _plain(x).alias("source")))
    sets = F.transform(F.coalesce(p["Source"]["TypeSet"], F.array()), lambda x: F.struct(F.when(_plain(x).startswith("DefinedType."), "defined").otherwise("kind").alias("source_kind"), F.regexp_replace(_plain(x), r"^DefinedType\.", "").alias("source")))
    return found.select(p["Name"].alias("name"), p["Event"].alias("event"), p["Handler"].alias("handler"), F.inline(F.concat(types, sets)))


def subsystems(spark: SparkSession, root: str) -> DataFrame:
    """Contents of subsystems: name, relation (object, child), item."""
    schema = "Subsystem struct<Properties: struct<Name: string, Content: struct<Item: array<string>>>, ChildObjects: struct<Subsystem: array<string>>>"
    found = _read(spark, root, "MetaDataObject", schema).where("Subsystem IS NOT NULL")
    rows = lambda c, kind: F.transform(F.filter(F.coalesce(F.col(c), F.array()), lambda x: F.trim(x) != ""), lambda x: F.struct(F.lit(kind).alias("relation"), F.trim(x).alias("item")))
    return found.select(F.col("Subsystem.Properties.Name").alias("name"), F.inline(F.concat(rows("Subsystem.Properties.Content.Item", "object"), rows("Subsystem.ChildObjects.Subsystem", "child"))))


def scheduled_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Scheduled jobs: name, method, used, predefined."""
    schema = "ScheduledJob struct<Properties: struct<Name: string, MethodName: string, Use: string, Predefined: string>>"
    p = F.col("ScheduledJob.Properties")
    found = _read(spark, root, "MetaDataObject", schema).where(p.isNotNull())
    return found.select(p["Name"].alias("name"), p["MethodName"].alias("method"), (F.lower(p["Use"]) == "true").alias("used"), (F.lower(p["Predefined"]) == "true").alias("predefined"))


def _plain_tag(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _trees(spark: SparkSession, root: str, name: str, walk, schema: str) -> DataFrame:
    """Rows that ``walk`` (path, root element) gives for each file; one file is read whole by one task.

    Elements nest to any depth, which a fixed schema can't say. Files that don't parse give no rows.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, value in zip(pdf["path"], pdf["value"]):
                try:
                    top = ElementTree.fromstring(value)
                except ElementTree.ParseError:
                    continue
                rows += walk(path, top)
            yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(run, schema)


def form_items(spark: SparkSession, root: str) -> DataFrame:
    """Contents of forms: path, part (item, attribute, command, event), kind, name, parent, detail.

    Items nest; ``parent`` is the item around one, or empty. An event's name is the event, its
    detail the handler and its parent the item that has it; an attribute's detail is its types.
    """
    parts = {"Attributes": "attribute", "Commands": "command"}

    def walk(path: str, top: ElementTree.Element) -> list[tuple]:
        rows: list[tuple] = []
        stack = [(top, "")]
        while stack:
            element, parent = stack.pop()
            for child in element:
                tag = _plain_tag(child.tag)
                if tag == "Events":
                    rows.extend((path, "event", "Event", e.get("name") or "", parent, (e.text or "").strip()) for e in child)
                elif tag == "ChildItems":
                    for item in child:
                        name = item.get("name") or ""
                        detail = next(((x.text or "").strip() for x in item if _plain_tag(x.tag) == "DataPath"), "")
                        rows.append((path, "item", _plain_tag(item.tag), name, parent, detail))
                        stack.append((item, name))
                elif tag in parts and element is top:
                    for x in child:
                        types = [_plain_text(y.text) for y in x.iter() if _plain_tag(y.tag) == "Type" and (y.text or "").strip()]
                        action = [(y.text or "").strip() for y in x if _plain_tag(y.tag) == "Action"]
                        rows.append((path, parts[tag], _plain_tag(x.tag), x.get("name") or "", "", ",".join(types or action)))
        return rows

    return _trees(spark, root, "Form.xml", walk, "path string, part string, kind string, name string, parent string, detail string")


def _plain_text(value: str | None) -> str:
    return (value or "").strip().split(":", 1)[-1]


def predefined(spark: SparkSession, root: str) -> DataFrame:
    """Predefined items: path, name, code, description, folder, parent. Items nest to any depth."""

    def walk(path: str, top: ElementTree.Element) -> list[tuple]:
        rows: list[tuple] = []
        stack = [(top, "")]
        while stack:
            element, parent = stack.pop()
            for child in element:
                tag = _plain_tag(child.tag)
                if tag == "Item":
                    own = {_plain_tag(x.tag): (x.text or "").strip() for x in child}
                    rows.append((path, own.get("Name", ""), own.get("Code", ""), own.get("Description", ""), own.get("IsFolder", "") == "true", parent))
                    stack.append((child, own.get("Name", "")))
                elif tag == "ChildItems":
                    stack.append((child, parent))
        return rows

    return _trees(spark, root, "Predefined.xml", walk, "path string, name string, code string, description string, folder boolean, parent string")
