"""Column functions on names, comments and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(c: Column) -> Column:
    """Lower case, with io folded into ie."""
    return F.translate(F.lower(c), "ё", "е")


def tokens(c: Column) -> Column:
    """Words of a name or text in lower case, also cut at changes of case and between letters and digits.

    A run of capitals is one word until the capital that begins the next one.
    """
    bounds = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"
    cut = folded(F.regexp_replace(c, bounds, " "))
    return F.filter(F.split(cut, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def distinct_tokens(c: Column) -> Column:
    """The distinct words of :func:`tokens`, in no order; a long text is cut into words before its words are cut."""
    bounds = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"
    rough = F.array_distinct(F.split(c, r"[^\p{L}\p{N}]+"))
    fine = F.flatten(F.transform(rough, lambda w: F.split(folded(F.regexp_replace(w, bounds, " ")), " ")))
    return F.array_remove(F.array_distinct(fine), "")


# Endings of inflected words. Nouns made of verbs take the first part before a case.
_CASES = "а е и й о у ы ь ю я ам ах ей ем ею ие ий им ию их ия ов ой ом ою ям ях ами ием иям иях ями".split()
_ADJECTIVES = "ая ее ого его ое ому ему ую ые ый ым ыми ых юю яя ими".split()
_VERBS = "ать ять еть ить уть ывать ивать овать евать ировать".split()
_MADE = "ани ени яни овани ировани аци яци ировк к ок ек".split()
_PLURALS = ["(?<=[sxzh])es", "s"]
_ENDINGS = [*_CASES, *_ADJECTIVES, *_VERBS, *_MADE, *[m + c for m in _MADE for c in _CASES], *_PLURALS]


def word_key(c: Column) -> Column:
    """What the forms of one folded word have in common: the word without its longest known ending.

    At least three letters stay. Words are forms of each other if their keys are equal, so forms are
    found by an equality join.
    """
    return F.regexp_replace(c, f"^(.{{3,}}?)(?:{'|'.join(_ENDINGS)})$", "$1")


def lookup(c: Column, values: dict) -> Column:
    """The value of a key in a small fixed table, null for others."""
    return reduce(lambda out, pair: out.when(c == pair[0], pair[1]), values.items(), F.when(F.lit(False), F.lit(None)))


def masked(c: Column, length: int = 200) -> Column:
    """A log comment with UUIDs and digits masked, cut to ``length``."""
    uuid = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    return F.substring(F.regexp_replace(F.regexp_replace(c, uuid, "<uuid>"), "[0-9]+", "#"), 1, length)


def uid(*parts: Column) -> Column:
    """Hex of the first 16 bytes of SHA-256 over parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32)


def stem(c: Column) -> Column:
    """A word without up to three last letters; at least four stay."""
    return F.substring(c, F.lit(1), F.length(c) - F.least(F.lit(3), F.greatest(F.lit(0), F.length(c) - 4)))


def host(c: Column) -> Column:
    """Host of a URL: no scheme, port or path, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[:/?#].*$", ""))


def segments(c: Column) -> Column:
    """Path segments of a URL."""
    path = F.regexp_replace(F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.filter(F.split(path, "/"), lambda s: s != "")


def word_start(c: Column, stem: str) -> Column:
    """Whether a word begins with ``stem``, in any case."""
    return F.lower(c).rlike(r"(?<![\p{L}\p{N}])" + stem)


def normal_name(c: Column) -> Column:
    """A name for comparison: the two letters that exports write in two signs are composed, all in lower case."""
    # Composed letters and what they are composed of.
    pairs = (("\u0419", "\u0418\u0306"), ("\u0439", "\u0438\u0306"), ("\u0401", "\u0415\u0308"), ("\u0451", "\u0435\u0308"))
    return F.lower(reduce(lambda out, pair: F.replace(out, F.lit(pair[1]), F.lit(pair[0])), pairs, c))


def module_path(c: Column) -> Column:
    """A module's path with forward slashes, without leading or repeated ones, without the file's ending, in lower case."""
    slashes = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+", "/")
    return F.lower(F.regexp_replace(slashes, r"^\./|^/|\.bsl$", ""))


def unescaped(c: Column) -> Column:
    """A literal's value: doubled quotes are one, lines go on after a bar."""
    return F.replace(F.regexp_replace(c, r"\n\s*\|", "\n"), F.lit('""'), F.lit('"'))


def without_comments(c: Column) -> Column:
    """Code without comments; ``//`` inside a string is no comment."""
    return F.regexp_replace(c, r'("[^"]*")|//[^\n]*', "$1")


def top_arguments(c: Column) -> Column:
    """Arguments of a call's text between its brackets, split at commas outside strings and inner brackets."""
    signs = F.split(c, "")

    def step(s: Column, x: Column) -> Column:
        quoted = F.when(x == '"', ~s["quoted"]).otherwise(s["quoted"])
        depth = s["depth"] + F.when(quoted, 0).when(x == "(", 1).when(x == ")", -1).otherwise(0)
        ends = (x == ",") & ~quoted & (depth == 0)
        done = F.when(ends, F.array_append(s["done"], s["own"])).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(ends, "").otherwise(F.concat(s["own"], x)).alias("own"), depth.alias("depth"), quoted.alias("quoted"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("own"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"))
    found = F.aggregate(signs, start, step, lambda s: F.array_append(s["done"], s["own"]))
    return F.when(F.trim(c) == "", F.array().cast("array<string>")).otherwise(F.transform(found, lambda x: F.trim(x)))


def balanced(c: Column) -> Column:
    """Whether every bracket outside strings is closed and none is closed before it is opened."""
    bare = F.split(F.regexp_replace(c, r'"[^"]*"', ""), "")
    depth = lambda s, x: F.when(s < 0, s).otherwise(s + F.when(x == "(", 1).when(x == ")", -1).otherwise(0))
    return F.aggregate(bare, F.lit(0), depth) == 0


def signature(name: Column, params: Column, function: Column) -> Column:
    """A method's heading from its ``params`` (structs of name, by_value and default, which may be null)."""
    shown = F.transform(params, lambda p: F.concat(F.when(p["by_value"], "Val ").otherwise(""), p["name"], F.coalesce(F.concat(F.lit(" = "), p["default"]), F.lit(""))))
    return F.concat(F.when(function, "Function ").otherwise("Procedure "), name, F.lit("("), F.array_join(shown, ", "), F.lit(")"))


# Names of the types in the two languages.
TYPES = {"String": "Строка", "Number": "Число", "Boolean": "Булево", "Date": "Дата", "Array": "Массив", "Structure": "Структура", "Map": "Соответствие", "Undefined": "Неопределено"}


def local_type(c: Column) -> Column:
    """A type's name in the other language, or as it is."""
    return F.coalesce(lookup(c, TYPES), c)


def type_tokens(c: Column) -> Column:
    """Types that a description names, as "Array of String" names two."""
    return F.filter(F.split(c, r"(?i)\s+(?:of|из)\s+|\s*,\s*"), lambda x: x != "")


def line_and_column(source: Column, offset: Column) -> Column:
    """Struct of line and column, from 1, of a character offset."""
    before = F.left(source, offset)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.struct(line.alias("line"), (offset - F.length(before) + F.length(F.substring_index(before, "\n", -1)) + 1).alias("column"))


def filled_uuid(c: Column) -> Column:
    """Whether a cell is a UUID that is not all zeros."""
    return c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$") & (c != "00000000-0000-0000-0000-000000000000")


def export_age(exported: Column, now: Column, stale_days: int = 7) -> Column:
    """Struct of an export's age in whole days and whether it is stale."""
    days = F.datediff(now, exported)
    return F.struct(days.alias("days"), (days >= stale_days).alias("stale"))
