"""Rule engines over facts: every rule is a predicate, every finding a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def named(rule: str, df: DataFrame, *keys: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), *keys)


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, found)


def visibility(objects: DataFrame, contents: DataFrame, interface: DataFrame, options: DataFrame, sections: DataFrame, grants: DataFrame) -> DataFrame:
    """``rule, object``: why objects can't be seen.

    ``contents`` have subsystem and object; ``interface`` object and shown; ``options`` object and
    enabled (an object is hidden when all of its options are off); ``sections`` subsystem and
    visible; ``grants`` object and value.
    """
    none = lambda df: objects.join(df.select("object").distinct(), "object", "left_anti")
    off = options.groupBy("object").agg(F.bool_or("enabled").alias("on")).where("NOT on")
    shut = contents.join(sections, "subsystem").groupBy("object").agg(F.bool_or("visible").alias("open")).where("NOT open")
    return union(
        named("NotInAnySubsystem", none(contents), "object"),
        named("NotInCommandInterface", none(interface.where("shown")), "object"),
        named("HiddenByFunctionalOption", objects.join(off, "object", "left_semi"), "object"),
        named("SectionHidden", objects.join(shut, "object", "left_semi"), "object"),
        named("NoRoleGrantsRights", none(grants.where("value")), "object"),
    )


#: Events of a write in the order in which they happen.
EVENTS = ("BeforeWrite", "OnWrite", "Posting", "UndoPosting")


def write_steps(handlers: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``object, step, event, source, name``: what runs when an object is written, in order.

    Both have object, event and name. An event's own handler runs before its subscriptions, which
    have no order of their own and are shown by name.
    """
    place = F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event"))
    rows = handlers.select("object", "event", F.lit("handler").alias("source"), "name").union(subscriptions.select("object", "event", F.lit("subscription"), "name")).where(place > 0)
    order = W.partitionBy("object").orderBy(place, "source", "name")
    return rows.select("object", F.row_number().over(order).alias("step"), "event", "source", "name")


def write_warnings(handlers: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``rule, object``: several subscriptions to one event, movements before posting, writes inside a handler, no check for loading.

    ``handlers`` also have writes, moves and checks_load.
    """
    several = subscriptions.groupBy("object", "event").count().where("count > 1").select("object").distinct()
    # one pass over the handlers says for each object which of their rules it breaks
    event = F.col("event")
    broken = {
        "MovementsUnavailable": F.bool_or(F.col("moves") & (event == "BeforeWrite")),
        "WriteInsideHandler": F.bool_or(F.col("writes") & (event == "OnWrite")),
        "NoExchangeLoadCheck": F.bool_and(F.when(event.isin("BeforeWrite", "OnWrite"), ~F.col("checks_load"))),
    }
    own = handlers.groupBy("object").agg(*[c.alias(rule) for rule, c in broken.items()])
    rules = F.filter(F.array(*[F.when(F.col(rule), rule) for rule in broken]), lambda r: r.isNotNull())
    return union(named("SubscriptionOrder", several, "object"), own.select(F.explode(rules).alias("rule"), "object"))


# Words that open and close a loop, in the two spellings.
LOOP, END_LOOP = r"(?iuU)^\s*(для|пока|for|while)\b.*(цикл|do)\s*$", r"(?iuU)^\s*(конеццикла|enddo)\b"
READS, LOCK, BALANCE, WRITE_FLAG = r"(?iuU)\.(выполнить|execute)\(", r"(?iuU)\.(заблокировать|lock)\(", r"(?iuU)\.(остатки|balance)\(", r"(?iuU)\.(записывать|write)\s*=\s*(истина|true)"


def posting_review(lines: DataFrame) -> DataFrame:
    """``rule, module, line`` of a posting handler's ``lines`` (module, line, text).

    A query in a loop, a balance that is read before any lock, and a handler that never sets the
    write flag (line 0). One window per module gives the depth of loops and whether a lock came.
    """
    text = F.col("text")
    so_far = W.partitionBy("module").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    opened = F.when(text.rlike(LOOP), 1).when(text.rlike(END_LOOP), -1).otherwise(0)
    seen = lines.select("module", "line", "text", F.sum(opened).over(so_far).alias("depth"), F.max(text.rlike(LOCK)).over(so_far).alias("locked"))
    flag = lines.groupBy("module").agg(F.bool_or(text.rlike(WRITE_FLAG)).alias("set")).where("NOT set")
    return union(
        named("QueryInLoop", seen.where((F.col("depth") > 0) & text.rlike(READS)), "module", "line"),
        named("BalanceReadWithoutLock", seen.where(text.rlike(BALANCE) & ~F.col("locked")), "module", "line"),
        flag.select(F.lit("NoWriteFlag").alias("rule"), "module", F.lit(0).alias("line")),
    )


def form_conflicts(interceptors: DataFrame, attributes: DataFrame) -> DataFrame:
    """``rule, target``: extensions that get in each other's way on a form.

    ``interceptors`` have target, extension, mode, continues and wired (the base binds the event
    itself); ``attributes`` target, extension, name, prefixed and removes.
    """
    instead = interceptors.where("mode = 'instead'")
    many = lambda df, keys: df.groupBy(*keys).agg(F.countDistinct("extension").alias("n")).where("n > 1").select("target").distinct()
    return union(
        named("InsteadWithoutContinue", instead.where("NOT continues").select("target").distinct(), "target"),
        named("InsteadDuplicatesBaseWiring", instead.where("wired").select("target").distinct(), "target"),
        named("MultipleChangeAttributes", many(attributes, ["target"]), "target"),
        named("NameCollision", many(attributes, ["target", "name"]), "target"),
        named("UnprefixedName", attributes.where("NOT prefixed").select("target").distinct(), "target"),
        named("ChangeAttributesWithRemoval", attributes.where("removes").select("target").distinct(), "target"),
    )


def usages(members: DataFrame, grants: DataFrame, templates: DataFrame) -> DataFrame:
    """``object, place, name, n``: where objects are used: as types of fields, in roles, in templates.

    ``members`` have owner and types (an array); ``grants`` role and object; ``templates`` name and objects (an array).
    """
    count = lambda df, place, name: df.groupBy("object", F.lit(place).alias("place"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    typed = members.select("owner", F.explode(F.array_distinct("types")).alias("object"))
    shown = templates.select("name", F.explode(F.array_distinct("objects")).alias("object"))
    return union(count(typed, "type", "owner"), count(grants, "role", "role"), count(shown, "template", "name"))


def validated(calls: DataFrame, functions: DataFrame, objects: DataFrame, attributes: DataFrame) -> DataFrame:
    """``rule, file, line``: findings of the code validator that facts decide.

    ``calls`` have file, line, function, args, object (nullable, a metadata object that is named),
    assigns (nullable, a name that is assigned to) and form; ``functions`` function, least and most
    arguments; ``attributes`` form and name.
    """
    site = ["file", "line"]
    known = calls.join(functions, "function", "left")
    named_objects = calls.where("object IS NOT NULL").join(objects.select("object").distinct(), "object", "left_anti")
    assigned = calls.where("assigns IS NOT NULL")
    shadows = assigned.join(attributes.select("form", F.col("name").alias("assigns")).distinct(), ["form", "assigns"], "left_semi")
    return union(
        named("UnknownGlobalFunction", known.where("least IS NULL"), *site),
        named("WrongArgCount", known.where("args < least OR args > most"), *site),
        named("UnknownMetadataObject", named_objects, *site),
        named("AssignToGlobalName", assigned.join(functions.select(F.col("function").alias("assigns")), "assigns", "left_semi"), *site),
        named("LocalShadowsAttribute", shadows, *site),
    )


def resolver_diagnostics(calls: DataFrame) -> DataFrame:
    """``rule, site``: resolved calls from another module of what is not exported, or from a context where it can't run.

    ``calls`` have site, same_module, exported, caller_server, callee_server (whether each runs on the server).
    """
    return union(
        named("NotExported", calls.where("NOT same_module AND NOT exported"), "site"),
        named("ContextMismatch", calls.where("NOT caller_server AND callee_server"), "site"),
    )


def runs_on_server(kind: Column, directive: Column) -> Column:
    """Whether code runs on the server: a directive decides, else the kind of its module."""
    return F.when(directive == "server", True).when(directive == "client", False).otherwise(kind != "form")
