"""HTTP calls stitched to the endpoints that they reach, over a trie of path templates.

The trie is a table: a node for each beginning of a template, an edge for each segment, and for each
node the endpoints below it. Calls walk down it level by level, all at once: a level is one equality
join on (node, segment), once with the call's own segment and once with the sign for any. So a call
meets only templates that its path agrees with so far, however many there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import kept, parted, side

# How sure a stitch is, by whether the host names the project and the path is whole.
SURE = {(True, "static"): 0.9, (True, "prefix"): 0.7, (False, "static"): 0.6, (False, "prefix"): 0.5}
#: Segments that stand for one segment, and for the rest.
ANY, REST = "{}", "*"


def segments(path: Column) -> Column:
    """Segments of a path without scheme, host, query or anchor, decoded, in lower case."""
    return F.transform(text.segments(F.trim(path)), lambda x: F.lower(F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)))


def _template(root: Column, template: Column) -> Column:
    """Segments of an endpoint, parameters as one sign; nothing counts after a star."""
    own = F.concat(segments(root), F.transform(segments(template), lambda x: F.when(x.startswith("{") & x.endswith("}"), ANY).otherwise(x)))
    star = F.array_position(own, REST)
    return F.when(star > 0, F.slice(own, F.lit(1), star.cast("int"))).otherwise(own)


#: Classes of endpoints, met by calls, that one task judges.
PART = 500_000


def trie(endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (``node, segment, to``) and, for every node, the endpoints below it (``node, endpoints, project, verb, root, path, leaf``).

    Endpoints of a project with the same path and verb are one class, as every call is judged alike for them;
    ``leaf`` is whether their path ends at the node.
    """
    own = endpoints.where(F.size(segments(F.col("root"))) > 0).select("endpoint", "project", F.upper("verb").alias("verb"), F.size(segments(F.col("root"))).alias("root"), _template(F.col("root"), F.col("template")).alias("path"))
    own = own.groupBy("project", "verb", "root", "path").agg(F.collect_set("endpoint").alias("endpoints"))
    heads = own.select("*", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("depth"))
    name = lambda n: F.array_join(F.slice("path", F.lit(1), n), "/")
    below = heads.select(name(F.col("depth")).alias("node"), "endpoints", "project", "verb", "root", "path", (F.col("depth") == F.size("path")).alias("leaf"))
    edges = heads.where("depth > 0").select(name(F.col("depth") - 1).alias("node"), F.get("path", F.col("depth") - 1).alias("segment"), name(F.col("depth")).alias("to")).distinct()
    return kept(edges), kept(below)


def _ends(path: Column, known: Column, partial: Column, suffix: Column) -> Column:
    """Whether a template's path can end with a call's known end.

    What is not known between beginning and end is at least a segment, or a part of one where either side is cut inside it.
    """
    own = F.split_part(F.split_part(suffix, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    inside = ~own.startswith("/")
    tail = segments(own)
    off = F.size(path) - F.size(tail)
    least = known + F.when(~partial & ~inside, 1).when(partial & inside, -1).otherwise(0)

    def agrees(x: Column, i: Column) -> Column:
        mine = F.get(path, off + i)
        return (mine == ANY) | F.when(inside & (i == 0), mine.endswith(x)).otherwise(mine == x)

    fits = F.forall(F.arrays_zip(tail.alias("x"), F.sequence(F.lit(0), F.size(tail) - 1).alias("i")), lambda z: agrees(z["x"], z["i"]))
    return (F.size(tail) == 0) | F.array_contains(path, REST) | ((off >= least) & fits)


def stitched(calls: DataFrame, endpoints: DataFrame, projects: DataFrame) -> DataFrame:
    """``id, kind, reason, endpoints, confidence`` of every call.

    ``calls`` have id, verb (empty if not known), host (empty if not known), path, path_kind (static, prefix,
    dynamic), suffix and reason; ``endpoints`` endpoint, project, root, template and verb; ``projects``
    host and project of the hosts that are mapped. Kinds: stitched; external (the host is not
    mapped, or a whole path leads nowhere); dynamic (the path can't be told); unknown (a part
    of a path leads nowhere, or the project has no endpoints).
    """
    edges, below = trie(endpoints)
    loaded = endpoints.select("project").distinct().withColumn("loaded", F.lit(True))
    c = calls.join(projects.select("host", F.col("project").alias("wanted")), "host", "left")
    c = c.join(F.broadcast(loaded.withColumnRenamed("project", "wanted")), "wanted", "left")  # one row a project
    prefix = F.col("path_kind") == "prefix"
    whole = segments(F.col("path"))
    cut = prefix & ~F.col("path").rlike("[?#]") & (F.col("path") != "") & ~F.col("path").endswith("/") & (F.size(whole) > 0)
    c = c.select("id", "verb", "host", "wanted", "loaded", "path_kind", "suffix", "reason", whole.alias("s"), cut.alias("partial"))
    known = F.size("s") - F.col("partial").cast("int")
    c = c.withColumn("hs", F.array_position(F.slice("s", F.lit(1), known), "hs").cast("int")).withColumn("rest", F.slice("s", F.col("hs") + 1, F.size("s")))
    c = kept(c.withColumn("full", F.size("rest") - F.col("partial").cast("int")))
    open_calls = c.where("(host = '' OR loaded) AND path_kind IN ('static', 'prefix') AND hs > 0")
    level = kept(open_calls.select("id", F.lit("").alias("node"), F.lit(0).alias("at"), "rest", "full", "partial"))
    reached = []
    while True:
        n = level.count()
        if not n:
            break
        reached.append(level)
        steps = level.where(F.col("at") < F.col("full")).select("*", F.explode(F.array(F.get("rest", F.col("at")), F.lit(ANY))).alias("segment"))
        level = kept(steps.join(edges, ["node", "segment"]).select("id", F.col("to").alias("node"), (F.col("at") + 1).alias("at"), "rest", "full", "partial"))
    if not reached:
        reached = [level]
    seen = kept(reduce(DataFrame.union, reached))
    # a star below a node takes all that is left; else the known part must be used up
    done = seen.where(F.col("at") == F.col("full"))
    starred = seen.join(edges.where(F.col("segment") == REST), "node").select("id", F.col("to").alias("node"), "at", "rest", "full", "partial")
    last = F.get("rest", F.col("full"))
    # a segment that is cut meets the beginnings of all segments by equality
    cut = done.where("partial").select("id", "node", last.alias("begin"))
    begins = edges.where(~F.col("segment").isin(ANY, REST)).select("node", "to", F.explode(F.sequence(F.lit(0), F.length("segment"))).alias("n"), "segment").select("node", "to", F.left("segment", "n").alias("begin"))
    cut_inside = cut.join(begins, ["node", "begin"]).select("id", F.col("to").alias("node")).union(cut.join(edges.where(F.col("segment").isin(ANY, REST)), "node").select("id", F.col("to").alias("node")))
    ways = done.where("NOT partial").select("id", "node").union(cut_inside).union(starred.select("id", "node")).distinct()
    asking = c.select("id", "wanted", "host", "path_kind", "suffix", "partial", "full", F.size("rest").alias("size"), F.col("verb").alias("asked"))
    ways = kept(ways.join(asking, "id"))
    # few rows become many: parts are sized by how many classes the ways meet, and a call's stay in its part
    n_below = below.count()
    met_n = ways.join(below.groupBy("node").agg(F.count("*").alias("n"), F.count_if("leaf").alias("n_leaf")), "node").agg(F.sum(F.when(F.col("path_kind") == "static", F.col("n_leaf")).otherwise(F.col("n")))).first()[0]
    ways = parted(ways, "id", met_n or 0, PART)
    mine = (F.col("host") == "") | (F.col("project") == F.col("wanted"))
    rooted = F.col("full") >= F.col("root")
    # a whole path meets the classes that end where it does; before a root it only counts that there is one
    met = ways.where("path_kind = 'static'").join(side(below.where("leaf"), n_below), "node").union(ways.where("path_kind <> 'static'").join(side(below, n_below), "node")).where(mine & rooted)
    early = ways.where("path_kind = 'prefix'").join(side(below.select("node", "project", "root").distinct(), n_below), "node").where(mine & ~rooted).select("id", F.lit(True).alias("before")).distinct()
    tail = _ends(F.slice("path", F.col("root") + 1, F.size("path")), F.col("size") - F.col("root"), F.col("partial"), F.col("suffix"))
    good = met.where((F.col("path_kind") == "static") | (F.col("suffix") == "") | tail)
    allowed = (F.col("asked") == "") | (F.col("verb") == "") | F.col("verb").isin("ANY", "*") | (F.col("verb") == F.upper("asked"))
    # endpoints whose verb is another count where no verb fits
    lists = good.select("id", allowed.alias("allowed"), "endpoints").groupBy("id").agg(F.bool_or("allowed").alias("fits"), F.collect_list(F.when(F.col("allowed"), F.col("endpoints"))).alias("good"), F.collect_list("endpoints").alias("any"))
    hits = lists.select("id", "fits", F.array_join(F.array_sort(F.array_distinct(F.flatten(F.when(F.col("fits"), F.col("good")).otherwise(F.col("any"))))), ",").alias("reached"))
    out = c.join(hits, "id", "left").join(side(early, c.count()), "id", "left")
    named = F.col("host") != ""
    hit = F.col("fits").isNotNull()
    wrong_verb = ~F.col("fits")
    nowhere = F.when(F.col("hs").isNull() | (F.col("hs") == 0), F.when(prefix, "prefix-without-hs").otherwise("no-endpoint")).when(F.coalesce("before", F.lit(False)), "prefix-before-root").otherwise("no-endpoint")
    kind = F.when(named & F.col("wanted").isNull(), "external").when(~F.col("path_kind").isin("static", "prefix"), "dynamic").when(named & F.col("loaded").isNull(), "unknown").when(hit, "stitched").when(prefix, "unknown").otherwise("external")
    reason = F.when(named & F.col("wanted").isNull(), "host-unmapped").when(~F.col("path_kind").isin("static", "prefix"), F.when(F.col("reason") != "", F.col("reason")).otherwise("dynamic-path")).when(named & F.col("loaded").isNull(), "project-not-loaded")
    reason = reason.when(hit & wrong_verb, "verb-not-allowed").when(hit, F.when(named, "host-mapped").otherwise("path-only")).otherwise(nowhere)
    sure = reduce(lambda a, k: a.when((named == k[0]) & (F.col("path_kind") == k[1]), SURE[k]), SURE, F.when(F.lit(False), 0.0))
    is_hit = kind == "stitched"
    return out.select("id", kind.alias("kind"), reason.alias("reason"), F.when(is_hit, F.col("reached")).otherwise("").alias("endpoints"), F.when(is_hit, sure).otherwise(0.0).alias("confidence"))


def link_counts(stitches: DataFrame, owners: DataFrame) -> DataFrame:
    """``owner, stitched, external, dynamic, unknown``: how the calls of each owner (``id, owner``) end; the badge counts of its card."""
    joined = stitches.join(owners, "id")
    return joined.groupBy("owner").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("stitched", "external", "dynamic", "unknown")])
