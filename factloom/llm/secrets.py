"""Secret scans over whole texts with DataFrame functions only.

Three fixed patterns give the base spans. The method adds spans of kind ``entropy``: a window
slides over each candidate string (a run of key-like characters that holds a digit), keeping
counts per character that change by one character in and one out, and so the window's Shannon
entropy; a span runs from the first to the last window whose entropy reaches the threshold of
the candidate's character class. Base spans are cut out of a candidate, and each piece that is
left and holds a window is scanned by itself. UUIDs and strings named by the caller are
suppressed.

Defined cases: a null or empty text has no spans, counts of zero and the digest of the empty
string; offsets count code points; repeated rows are scanned alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns. The letters of an assignment's key and value may be in either case.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_MIN = 12
# Runs are maximal, so the least length may stand in the pattern itself.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Candidate strings of the entropy scan: key-like runs that hold a digit.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
WINDOW = 20
#: Least entropy in bits of a window, by the characters that a candidate is made of.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 2.9), ("upper", r"^[A-Z0-9]+$", 3.4), ("lower", r"^[a-z0-9]+$", 3.4), ("mixed", r"^.+$", 3.8))
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "array<struct<start:int,kind:int,end:int,piece:string>>"


def _spans(text: Column, kind: int, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """Matches of a pattern as (start, kind, end, piece), in order.

    Java's split gives the texts between the matches, so a match starts after all gaps and
    matches before it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), value.alias("value"))
    # running offsets in two steps, of blocks of about the root of their number and within each: a
    # fold copies what it has gathered at every step, so it stays short
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(found)))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(found) / width).cast("int") - 1), lambda i: F.slice(both, i * width + 1, width))
    lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"])))
    begins = F.aggregate(lengths, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))

    def within(block: Column, at: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            begin = s["at"] + F.length(x["gap"])
            end = begin + F.length(x["hit"])
            own = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("piece"))
            return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(s["out"], F.array(own))).otherwise(s["out"]).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda s: s["out"])

    run = F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), within))
    return F.when(F.regexp_like(text, F.lit(pattern)), run).otherwise(F.array().cast(SPAN))


def _windows(piece: Column) -> Column:
    """First and last window start of a candidate whose entropy reaches its class's threshold.

    Entropy of a window of w characters is log2 w - sum(c log2 c) / w over its counts c; the sum
    changes only by the counts of the character that comes in and the one that goes out.
    """
    need = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        need = F.when(piece.rlike(pattern), F.lit(bits)).otherwise(need)
    weight = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    code = lambda i: F.instr(F.lit(ALPHABET), F.substr(piece, i, F.lit(1))) - 1
    zero = F.array_repeat(F.lit(0), len(ALPHABET))

    def step(s: Column, i: Column) -> Column:
        into, out = code(i), F.when(i > WINDOW, code(i - WINDOW)).otherwise(F.lit(-1))
        gained = s["counts"][into]
        less = F.transform(s["counts"], lambda c, k: c + F.when(k == into, 1).otherwise(0))
        lost = F.when(out >= 0, less[out]).otherwise(F.lit(0))
        counts = F.transform(less, lambda c, k: c - F.when(k == out, 1).otherwise(0))
        total = s["total"] + weight(gained + 1) - weight(gained) + F.when(out >= 0, weight(lost - 1) - weight(lost)).otherwise(F.lit(0.0))
        ok = (i >= WINDOW) & (F.log2(F.lit(float(WINDOW))) - total / WINDOW >= need)
        begin = i - WINDOW
        return F.struct(
            counts.alias("counts"),
            total.alias("total"),
            F.when(ok & (s["first"] < 0), begin).otherwise(s["first"]).alias("first"),
            F.when(ok, begin).otherwise(s["last"]).alias("last"),
        )

    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.length(piece)), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _free(x: Column, base: Column) -> Column:
    """The pieces of a candidate of ``WINDOW`` characters or more that no base span (by start) covers."""

    def piece(begin: Column, end: Column) -> Column:
        own = F.struct(begin.alias("start"), F.lit(3).alias("kind"), end.alias("end"), F.substr(x["piece"], begin - x["start"] + 1, end - begin).alias("piece"))
        return F.when(end - begin >= WINDOW, F.array(own)).otherwise(F.array().cast(SPAN))

    return F.aggregate(
        F.filter(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
        F.struct(x["start"].alias("at"), F.array().cast(SPAN).alias("out")),
        lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), F.concat(s["out"], piece(s["at"], b["start"])).alias("out")),
        lambda s: F.concat(s["out"], piece(s["at"], x["end"])),
    )


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``base`` and ``added``: arrays of (start, kind, end, piece), by start then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn(
        "base", F.array_sort(F.concat(_spans(F.col("text"), 0, ASSIGN, 2, ASSIGN_MIN), _spans(F.col("text"), 1, ACCESS), _spans(F.col("text"), 2, HEX)))
    )
    listed = lambda x: x["piece"].rlike(UUID) | x["piece"].isin(*allow) if allow else x["piece"].rlike(UUID)
    candidates = F.filter(_spans(F.col("text"), 3, CANDIDATE), lambda x: x["piece"].rlike("[0-9]") & ~listed(x))
    pieces = F.filter(F.flatten(F.transform(candidates, lambda x: _free(x, F.col("base")))), lambda x: ~listed(x))
    scanned = F.transform(pieces, lambda x: F.struct(x.alias("x"), _windows(x["piece"]).alias("w")))
    hits = F.filter(scanned, lambda s: s["w"]["first"] >= 0)
    added = F.transform(
        hits,
        lambda s: F.struct(
            (s["x"]["start"] + s["w"]["first"]).alias("start"),
            F.lit(3).alias("kind"),
            (s["x"]["start"] + s["w"]["last"] + WINDOW).alias("end"),
            F.substr(s["x"]["piece"], s["w"]["first"] + 1, s["w"]["last"] - s["w"]["first"] + WINDOW).alias("piece"),
        ),
    )
    return base.withColumn("added", added).select("doc_id", "base", "added")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["kind"]], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans of each document."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
