"""Search and packing of context: fielded word search, intents, anchors, scores, coverage.

Searches never pair all with all: words meet query terms by the key of their forms, names meet
misspelt ones by equal segments, and everything else is aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import kept, parted, side

# How far a word counts by the field that holds it, and the weight of the place.
COVER = {"name": 1.0, "module": 0.7, "summary": 0.8, "doc": 0.5, "card": 0.7}
PLACE = {"name": 3.0, "module": 2.0, "summary": 1.0, "doc": 0.5, "card": 1.0}
WEAK = ("doc",)
# Words of a query that say nothing.
STOP_WORDS = "или для при что это как его под над без если либо чтобы также".split()
# Weights of the kinds of facts in a context.
CATEGORY = {
    "definition": 1.0, "binding": 1.0, "structure": 1.0, "query_text": 1.0, "posting_handler": 1.0, "body": 0.9, "handler": 0.9, "handler_body": 0.9, "writes_movements": 0.9, "movements": 0.9,
    "schema": 0.85, "owner_symbol": 0.8, "owning_symbols": 0.8, "register_access": 0.8, "references": 0.85, "callers": 0.85, "callees": 0.85, "caller": 0.85, "callee": 0.85, "server_calls": 0.8, "usages": 0.75,
    "tables_fields": 0.7, "interceptors": 0.7, "handler_intercepts": 0.55, "posting_handler_intercepts": 0.55, "attributes": 0.65, "subscriptions": 0.7, "roles": 0.85, "rights": 0.85, "rls": 0.7, "profiles": 0.55,
    "forms": 0.55, "exchanges": 0.55, "writer_intercepts": 0.55, "query_intercepts": 0.55, "query_in_body": 0.55, "register_reads": 0.45, "member_summary": 0.6, "scheduled_job": 0.4,
}
#: Letters that the key of a word keeps at least.
HEAD = 3
#: Methods whose words one task cuts, and pairs of a query's term and a method that one task counts.
METHODS, HITS = 10_000, 2_000_000
#: Texts that one task splits.
TEXTS = 5_000


def query_terms(queries: DataFrame, most: int = 32) -> DataFrame:
    """``query, term, key, n`` of each query's ``text``: words of three letters or more, once each, in order.

    A word that is a form of an earlier one is left out; at most ``most`` stay.
    """
    each = queries.select("query", F.posexplode(text.tokens(F.col("text"))).alias("n", "term")).where((F.length("term") > 2) & ~F.col("term").isin(*STOP_WORDS))
    first = each.groupBy("query", text.word_key(F.col("term")).alias("key")).agg(F.min(F.struct("n", "term")).alias("m"))
    n = F.row_number().over(W.partitionBy("query").orderBy("m.n")) - 1
    return first.select("query", F.col("m.term").alias("term"), "key", n.alias("n")).where(F.col("n") < most)


def fielded_search(methods: DataFrame, fields: list[str], terms: DataFrame, n_methods: int, n_terms: int) -> DataFrame:
    """``query, id, matched, strong, coverage, name_fit, score`` of the methods that hold a term.

    ``methods`` have id and the text ``fields``; ``terms`` come from :func:`query_terms`. A term
    weighs ln(1 + methods / holders), counted for the strong fields and, for the doc, anywhere; it
    covers by the best of its fields, and its places add to the score. The name fits by the share
    of its words that are asked for. Words meet terms by their first letters, which the keys of their
    forms share, then by the keys; ``n_terms`` rows are broadcast if they are few, so that no word
    of a method that is not asked for is shuffled.
    """
    flag = {f: 1 << i for i, f in enumerate(fields)}

    def of(field: str) -> Column:
        return F.transform(text.distinct_tokens(F.coalesce(field, F.lit(""))), lambda w: F.struct(F.lit(flag[field]).alias("flag"), w.alias("word")))

    # few bytes of names are much work, so methods are parted by their number, and what they meet by its own
    methods = parted(methods, "id", n_methods, METHODS)
    words = methods.select("id", F.size(text.distinct_tokens(F.col("name"))).alias("name_words"), F.inline(F.flatten(F.array(*map(of, fields))))).withColumn("head", F.left("word", F.lit(HEAD)))
    # words meet the distinct keys, whatever the number of queries, and are put together where they stand: fields are bits
    keys = terms.select("key", F.left("key", F.lit(HEAD)).alias("head")).distinct()
    met = words.join(side(keys, n_terms), "head").where(text.word_key(F.col("word")) == F.col("key"))
    held = kept(met.groupBy("id", "name_words", "key").agg(F.bit_or("flag").alias("f")))
    has = lambda f: F.col("f").bitwiseAND(flag[f]) > 0
    strong = reduce(lambda a, b: a | b, [has(f) for f in fields if f not in WEAK])
    df = held.groupBy("key").agg(F.log(1 + n_methods / F.count("*")).alias("any"), F.when(F.count_if(strong) > 0, F.log(1 + n_methods / F.count_if(strong))).otherwise(0.0).alias("firm"))
    best = F.greatest(*[F.when(has(f), COVER[f] * F.col("any" if f in WEAK else "firm")).otherwise(0.0) for f in fields])
    place = reduce(lambda a, b: a + b, [F.when(has(f), PLACE[f]).otherwise(0.0) for f in fields])
    worth = held.join(side(df, n_terms), "key").select("key", "id", "name_words", strong.alias("strong"), best.alias("best"), place.alias("place"), has("name").alias("named"))
    asked = side(terms.select("query", "key"), n_terms)
    many = held.groupBy("key").agg(F.count("*").alias("n")).join(terms.groupBy("key").agg(F.count("*").alias("m")), "key").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    found = parted(worth, "id", many or 0, HITS).join(asked, "key").groupBy("query", "id", "name_words").agg(
        F.count("*").alias("matched"), F.count_if("strong").alias("strong"), F.sum("best").alias("coverage"), F.sum("place").alias("score"), F.count_if("named").alias("in_name")
    )
    fit = F.when(F.col("name_words") > 0, F.least(F.lit(1.0), F.col("in_name") / F.col("name_words"))).otherwise(0.0)
    return found.select("query", "id", "matched", "strong", F.round("coverage", 6).alias("coverage"), F.round(fit, 9).alias("name_fit"), "score")


def ranked_texts(docs: DataFrame, terms: DataFrame, letters: str) -> tuple[DataFrame, DataFrame]:
    """What text ranking needs of ``docs`` (doc_id, text): each text's number of words and how often it
    holds each of the ``terms`` (one column ``word``, at most some dozens), and the sums over all texts.

    A text is split once and only words that are asked for leave its row. ``letters`` are those of a word.
    A file's row group is one task's, however many texts it holds, so texts are parted by their number.
    """
    asked = terms.agg(F.array_sort(F.collect_set("word")).alias("asked"))  # one row of a query's terms
    words = F.array_remove(F.split(F.lower("text"), f"[^{letters}]+"), "")
    texts = parted(docs.select("doc_id", "text"), ["doc_id", "text"], docs.count(), TEXTS)
    own = texts.select("doc_id", words.alias("w")).join(F.broadcast(asked))
    hits = F.transform(F.array_intersect("w", "asked"), lambda x: F.struct(x.alias("word"), (F.size("w") - F.size(F.array_remove("w", x))).alias("f")))
    # texts without words go when the table is read: a filter on their words would split every text once more
    per = kept(own.select("doc_id", F.size("w").alias("n"), hits.alias("hits"))).where("n > 0")
    return per, per.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))


def sections(found: DataFrame, full: int, brief: int) -> DataFrame:
    """The first ``full`` methods of each query and ``section``, and ``brief`` more by name only.

    Within what is shown, deprecated methods come last.
    """
    order = W.partitionBy("query", "section").orderBy(F.desc("coverage"), F.desc("name_fit"), F.desc("score"), "name", "id")
    cut = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= full + brief)
    shown = W.partitionBy("query", "section", F.col("_n") <= full).orderBy(F.col("deprecated").cast("int"), "_n")
    return cut.select("query", "section", "id", F.when(F.col("_n") <= full, "full").otherwise("brief").alias("shape"), F.row_number().over(shown).alias("n"))


def intents(tasks: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """``id, intent, confidence``: the intent with most stems at word beginnings; ties go to the earlier one.

    Without any the intent is ``unknown`` with confidence 0.
    """
    votes = [sum((text.word_start(F.col("text"), w).cast("int") for w in words), F.lit(0)) for words in lexicon.values()]
    total = sum(votes, F.lit(0))
    named = F.array(*[F.struct(v.alias("n"), F.lit(-i).alias("k"), F.lit(name).alias("intent")) for i, (name, v) in enumerate(zip(lexicon, votes))])
    best = tasks.select("id", total.alias("total"), F.array_max(named).alias("m"))
    return best.select("id", F.when(F.col("total") > 0, F.col("m.intent")).otherwise("unknown").alias("intent"), F.when(F.col("total") > 0, F.round(F.col("m.n") / F.col("total"), 9)).otherwise(0.0).alias("confidence"))


def near_names(asked: DataFrame, names: DataFrame, edits: int = 2) -> DataFrame:
    """Rows of ``asked`` (``name`` and others) with every ``found`` of ``names`` at most ``edits`` edits away.

    A name is cut into ``edits + 1`` segments, one of which is whole in any name that few edits
    away, moved by ``edits`` at most. So a name has that many keys however long it is, only an asked name
    tries its places, and nothing is lost.
    """
    m = edits + 1
    cut = lambda size, k: F.floor(size * k / m).cast("int")
    size = F.length("found")
    segments = F.array(*[F.struct(F.lit(k).alias("k"), F.substring(F.col("found"), cut(size, F.lit(k)) + 1, cut(size, F.lit(k + 1)) - cut(size, F.lit(k))).alias("part")) for k in range(m)])
    keyed = names.select("found", size.alias("size"), F.inline(segments))
    own = F.length("name")
    sizes = F.filter(F.sequence(own - edits, own + edits), lambda n: n >= 0)

    def tries(n: Column, k: int) -> Column:
        begin = cut(n, F.lit(k))
        length = cut(n, F.lit(k + 1)) - begin
        starts = F.filter(F.sequence(begin - edits, begin + edits), lambda p: (p >= 0) & (p + length <= own))
        return F.transform(starts, lambda p: F.struct(n.alias("size"), F.lit(k).alias("k"), F.substring(F.col("name"), p + 1, length).alias("part")))

    places = lambda n: F.flatten(F.array(*[tries(n, k) for k in range(m)]))
    probes = asked.select("*", F.explode(F.array_distinct(F.flatten(F.transform(sizes, places)))).alias("_p"))
    probes = probes.select(*asked.columns, "_p.size", "_p.k", "_p.part")
    near = probes.join(keyed, ["size", "k", "part"]).where(F.levenshtein("name", "found") <= edits)
    return near.select(*asked.columns, "found").distinct()


def anchors(tasks: DataFrame, objects: DataFrame, symbols: DataFrame, most: int = 6) -> DataFrame:
    """``task, kind, name, strength``: what a task names, the surest first.

    ``tasks`` have task and name (lower case), the others name. An exact object or symbol
    counts 1.0 or 0.95; only a task without either is looked for among symbols that are two edits away
    (0.6), and only then among those that share its first word (0.4).
    """
    rows = lambda df, kind, strength: df.select("task", F.lit(kind).alias("kind"), F.col("found").alias("name"), F.lit(strength).alias("strength"))
    exact = rows(tasks.join(objects.select("name").distinct().withColumn("found", F.col("name")), "name"), "object", 1.0)
    exact = exact.union(rows(tasks.join(symbols.select("name").distinct().withColumn("found", F.col("name")), "name"), "symbol", 0.95))
    left = tasks.join(exact, "task", "left_anti")
    names = symbols.select(F.col("name").alias("found")).distinct()
    fuzzy = rows(near_names(left, names, 2), "fuzzy", 0.6)
    word = lambda c: F.get(F.split(c, " "), F.lit(0))
    rest = left.join(fuzzy, "task", "left_anti")
    full = rows(rest.join(names, word(rest["name"]) == word(F.col("found"))), "text", 0.4)
    order = W.partitionBy("task").orderBy(F.desc("strength"), "kind", "name")
    return exact.union(fuzzy).union(full).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def candidate_score(category: Column, strength: Column, direction: Column, depth: Column, confidence: Column, component: Column, cost: Column) -> Column:
    """Worth of a fact in a context for each sign that it costs; a step away leaves 0.6 of it."""
    weight = F.coalesce(text.lookup(category, CATEGORY), F.lit(0.5))
    return weight * strength * direction * F.pow(F.lit(0.6), F.greatest(depth, F.lit(0))) * confidence * component / F.greatest(cost, F.lit(1))


def packed_context(candidates: DataFrame, required: list[str] | Column, budget: int, block: int = 5_000) -> DataFrame:
    """``task, category, id, used, admitted`` of candidates that are admitted greedily within a budget.

    Required categories come first, in their order (or by a column of places), then the others; within
    each the best ``score``, then the id. A candidate that doesn't fit is skipped and later ones may still fit.
    A task's candidates are folded ``block`` at a time, each block from what the former one used;
    of tasks with one block, which are most, a single pass is enough. A block whose least cost is more
    than what is left admits nothing, so it is not folded: a task goes on with its next block that may.
    """
    place = required if isinstance(required, Column) else F.coalesce(text.lookup(F.col("category"), {c: i for i, c in enumerate(required)}), F.lit(len(required)))
    order = W.partitionBy("task").orderBy(place, F.desc("score"), "id")
    numbered = candidates.withColumn("k", F.row_number().over(order) - 1)
    # without a cost it can't be told that a block admits nothing
    # a task may be null, and joins meet those by a struct
    ordered = numbered.groupBy(F.struct("task").alias("task"), F.floor(F.col("k") / block).alias("part")).agg(F.array_sort(F.collect_list(F.struct("k", "id", "category", "cost"))).alias("c"), F.min(F.coalesce("cost", F.lit(0))).alias("least"))
    ordered = kept(ordered)
    parts = ordered.agg(F.max("part")).first()[0]

    def step(a: Column, x: Column) -> Column:
        ok = a["used"] + x["cost"] <= budget
        used = (a["used"] + F.when(ok, x["cost"]).otherwise(0)).cast("long")
        return F.struct(used.alias("used"), F.when(ok, F.array_append(a["out"], F.struct(x["k"].alias("k"), used.alias("used")))).otherwise(a["out"]).alias("out"))

    def folded(own: DataFrame) -> DataFrame:
        """What is admitted of each block, which is little, so that the fold carries no more."""
        none = F.struct(F.col("u").alias("used"), F.array().cast("array<struct<k:int,used:bigint>>").alias("out"))
        return own.select("task", "part", "u", *(["c"] if not parts else []), F.aggregate("c", none, step).alias("r"))

    def told(blocks: DataFrame) -> DataFrame:
        """The candidates of blocks (task, c, u, out): from one that is admitted to the next the same is used."""
        mark = lambda k, used, ok: F.struct(k.alias("k"), used.alias("used"), F.lit(ok).alias("ok"))
        first = F.get("c", F.lit(0))["k"]
        marked = blocks.select("task", "c", F.concat(F.array(mark(first, F.col("u"), False)), F.transform("out", lambda x: mark(x["k"], x["used"], True))).alias("marks"))
        until = lambda i: F.coalesce(F.get("marks", i + 1)["k"], first + F.size("c"))

        def run(m: Column, i: Column) -> Column:
            row = lambda x, j: F.struct(x["category"].cast("string").alias("category"), x["id"].alias("id"), m["used"].alias("used"), F.when(x["cost"].isNotNull(), m["ok"] & (j == 0)).alias("admitted"))
            return F.transform(F.slice("c", m["k"] - first + 1, until(i) - m["k"]), row)

        return marked.select("task.task", F.inline(F.flatten(F.transform("marks", run))))

    if not parts:
        return told(folded(ordered.withColumn("u", F.lit(0).cast("long"))).select("task", "c", "u", "r.out"))
    heads = kept(ordered.select("task", "part", "least"))
    ends = []
    following = heads.where("part = 0").select("task", "part", F.lit(0).cast("long").alias("u"))
    while True:
        ends.append(kept(folded(ordered.join(following, ["task", "part"])).select("task", "part", "r.used", "r.out")))
        last = ends[-1].select("task", F.col("part").alias("_last"), F.col("used").alias("u"))
        following = heads.join(last, "task").where((F.col("part") > F.col("_last")) & (F.col("least") <= budget - F.col("u"))).groupBy("task").agg(F.min("part").alias("part"), F.first("u").alias("u"))
        following = kept(following)
        if following.isEmpty():
            break
    # a block begins with what the last one that was folded has used
    before = F.last("used", ignorenulls=True).over(W.partitionBy("task").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    began = heads.join(reduce(DataFrame.union, ends), ["task", "part"], "left").select("task", "part", F.coalesce(before, F.lit(0).cast("long")).alias("u"), F.coalesce("out", F.array()).alias("out"))
    return told(ordered.join(began, ["task", "part"]))


def coverage(packed: DataFrame, tasks: DataFrame, required: list[str], collected: list[str]) -> DataFrame:
    """``task, category, returned, total, status`` of the required categories of every task.

    Nothing found is complete if the category was collected, else missing; nothing admitted is
    missing, some is partial, all is complete.
    """
    wanted = tasks.select("task").distinct().withColumn("category", F.explode(F.array(*map(F.lit, required))))
    n = packed.groupBy("task", "category").agg(F.count("*").alias("total"), F.count_if("admitted").alias("returned"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    found = wanted.join(n, ["task", "category"], "left").select("task", "category", zero("returned"), zero("total"))
    status = F.when((F.col("total") == 0) & F.col("category").isin(*collected), "complete_empty").when(F.col("returned") == 0, "missing").when(F.col("returned") < F.col("total"), "partial").otherwise("complete_inline")
    return found.withColumn("status", status)


def extension_points(methods: DataFrame, stems: list[str]) -> DataFrame:
    """Methods by what of them holds the stems: 3 for the name, 2 for the module, 1 for the doc, each stem by its best."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    each = [F.when(low("name").contains(s), 3).when(low("module").contains(s), 2).when(low("doc").contains(s), 1).otherwise(0) for s in stems]
    return methods.withColumn("score", sum(each, F.lit(0))).where("score > 0")
