"""Drafts checked against what there is: for each routine of a draft the methods that do the same already.

Routines come from the tokens of the draft, with the comment above them. Their words meet those of
all methods by the keys of word forms, all drafts at once; only counts are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import kept, parted, side
from . import search, tokens

# Beginnings of the names of event handlers, which no method replaces.
HANDLERS = ("при", "перед", "после", "обработка", "on", "before", "after")


def documented(sources: DataFrame) -> DataFrame:
    """``module, number, routine, line, doc, summary`` of every routine of ``sources`` (module, text).

    ``doc`` is the comment that ends on the line above the heading, or above its directives, whole lines only;
    ``summary`` is its first line that says something.
    """
    found = kept(tokens.pieces(sources))
    by_line = W.partitionBy("module", "line")
    alone = found.where("kind <> 'space'").select("*", F.count("*").over(by_line).alias("_n"), F.min("pos").over(by_line).alias("_first"))
    comments = alone.where("kind = 'comment' AND _n = 1").select("module", "line", F.trim(F.regexp_replace("text", "^/+", "")).alias("text"))
    # lines that follow each other share the difference to their number
    island = F.col("line") - F.row_number().over(W.partitionBy("module").orderBy("line"))
    block = comments.withColumn("_block", island).groupBy("module", "_block").agg(F.max("line").alias("last"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("c"))
    own = F.transform("c", lambda x: x["text"])
    block = block.select("module", (F.col("last") + 1).alias("top"), F.array_join(own, "\n").alias("doc"), F.get(F.filter(own, lambda x: x != ""), F.lit(0)).alias("summary"))
    toks = tokens.tokens(sources)
    # the heading's top line: that of the directives and the asynchronous word right before it
    before = F.col("kind").isin("directive") | F.col("word").isin(*tokens.ASYNC)
    run = F.sum((~before).cast("int")).over(W.partitionBy("module").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    marked = toks.withColumn("_run", F.coalesce(run, F.lit(0))).withColumn("top", F.min("line").over(W.partitionBy("module", "_run")))
    tops = marked.where("heading").select("module", F.col("routine").alias("number"), "top")
    heads = tokens.routines(toks).select("module", "number", "routine", "line")
    return heads.join(tops, ["module", "number"]).join(block, ["module", "top"], "left").select("module", "number", "routine", "line", F.coalesce("doc", F.lit("")).alias("doc"), F.coalesce("summary", F.lit("")).alias("summary"))


def is_handler(name: Column) -> Column:
    """Whether a routine is named like a handler of an event."""
    first = F.get(text.tokens(name), F.lit(0))
    return F.coalesce(first.isin(*HANDLERS), F.lit(False))


def ready_made(drafts: DataFrame, methods: DataFrame, n_methods: int, most: int = 3) -> DataFrame:
    """``draft, section, id, n``: up to ``most`` methods of the library, and of others, for each draft routine.

    ``drafts`` have draft, name, doc and owner (the draft's own module, which is left out); ``methods`` id, owner,
    library, deprecated, name and summary. A library's method must hold two of the draft's words or more in name, owner or
    summary. Another method's name must be close from both sides: two words of the draft or more, two thirds
    of its own words, and half of the words of the draft's name. The rarest words count most.
    """
    named = search.query_terms(drafts.select(F.col("draft").alias("query"), F.col("name").alias("text"))).select("query", "key", F.lit(True).alias("of_name"))
    asked = search.query_terms(drafts.select(F.col("draft").alias("query"), F.concat_ws(" ", "name", "doc").alias("text"))).select("query", "key")
    asked = kept(asked.join(named, ["query", "key"], "left").withColumn("of_name", F.coalesce("of_name", F.lit(False))))
    sizes = asked.groupBy("query").agg(F.count("*").alias("terms"), F.count_if("of_name").alias("name_terms")).where("terms >= 2 AND name_terms > 0")
    n = asked.count()
    word = lambda c: F.transform(text.distinct_tokens(F.coalesce(c, F.lit(""))), text.word_key)
    live = parted(methods.where("NOT deprecated"), "id", n_methods, search.METHODS)
    keys = live.select("id", "owner", "library", F.array_distinct(word("name")).alias("_name"), word(F.concat_ws(" ", "owner", "summary")).alias("_rest"))
    each = keys.select("id", "owner", "library", F.size("_name").alias("name_words"), F.explode(F.array_union("_name", "_rest")).alias("key"), "_name")
    each = each.select("id", "owner", "library", "name_words", "key", F.array_contains("_name", F.col("key")).alias("in_name"))
    met = kept(each.join(side(asked.select("key").distinct(), n), "key", "left_semi"))
    worth = met.groupBy("key").agg(F.log(1 + n_methods / F.count("*")).alias("w"))
    many = met.groupBy("key").agg(F.count("*").alias("n")).join(asked.groupBy("key").agg(F.count("*").alias("m")), "key").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    joined = parted(met.join(side(worth, n), "key"), "id", many or 0, search.HITS).join(side(asked, n), "key")
    found = joined.groupBy("query", "id", "owner", "library", "name_words").agg(F.count("*").alias("matched"), F.count_if("in_name").alias("names"), F.count_if(F.col("in_name") & F.col("of_name")).alias("both"), F.round(F.sum(F.col("w") * F.when(F.col("in_name"), 1.0).otherwise(0.7)), 6).alias("score"))
    found = found.join(side(sizes, n), "query").join(side(drafts.select(F.col("draft").alias("query"), F.col("owner").alias("own")), n), "query")
    close = (F.col("names") >= 2) & (F.col("names") * 3 >= F.col("name_words") * 2) & (F.col("both") * 2 >= F.col("name_terms"))
    good = found.where(F.when(F.col("library"), F.col("matched") >= 2).otherwise(close) & ~F.col("owner").eqNullSafe(F.col("own")))
    section = F.when(F.col("library"), "library").otherwise("other")
    order = W.partitionBy("query", "library").orderBy(F.desc("score"), F.desc("names"), "id")
    return good.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(F.col("query").alias("draft"), section.alias("section"), "id", "n")
