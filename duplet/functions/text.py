"""Column functions over texts and token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token of the prose profile.
TOKEN = r"[\p{L}\p{N}]+"
#: Words that open an import line, and calls that mark one anywhere in it.
IMPORT_WORDS = ("import", "from", "require", "use", "include")
IMPORT_CALLS = ("require(", "import(")
#: Characters of a token of an import line; Spark's regular expressions know the property by this name.
REFERENCE = r"[\p{IsAlphabetic}\p{N}_./-]+"


def prose_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; numbers become NUM. Null: none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda x: F.when((x < ":") & x.rlike("^[0-9]+$"), F.lit("NUM")).otherwise(x))


def prose_lines(text: Column) -> Column:
    """The 1-based line of each token of prose_tokens(text)."""
    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")
    each = F.transform(lines, lambda line, i: F.array_repeat(i + 1, F.regexp_count(line, F.lit(TOKEN))))
    return F.flatten(each)


def content_hash(tokens: Column) -> Column:
    """128 bits, as hex, of a token sequence; a separator after each token keeps [a, b] apart from [ab]."""
    joined = F.when(F.size(tokens) == 0, F.lit("")).otherwise(F.concat(F.array_join(tokens, "\x1f"), F.lit("\x1f")))
    return F.substring(F.sha2(joined, 256), 1, 32)


def length_bound(a: Column, b: Column) -> Column:
    """The most that the ratio of sequences of lengths a and b can be; 1 if both are empty."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.least(a, b) / (a + b))


def overlap(shared: Column, a: Column, b: Column) -> Column:
    return shared.cast("double") / F.least(a, b)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def dotted_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), r"[/\\]", ".")


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


def is_import(line: Column) -> Column:
    first = F.element_at(F.split(F.ltrim(line), r"\s+"), 1)
    called = F.lit(False)
    for x in IMPORT_CALLS:
        called |= F.contains(line, F.lit(x))
    return first.isin(*IMPORT_WORDS) | called


def reference_names(token: Column, extensions: list[str]) -> Column:
    """What a token of an import line may name: the token without ./ and ../ before and a known extension after, and that with dots for slashes."""
    bare = F.regexp_replace(F.regexp_replace(token, r"^(\.{1,2}/)+", ""), r"^/+", "")
    bare = F.regexp_replace(bare, rf"(?<=.)\.({'|'.join(sorted(extensions))})$", "")
    return F.array_distinct(F.array(bare, F.regexp_replace(bare, r"/", ".")))


def escape_message(text: Column) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_property(text: Column) -> Column:
    text = escape_message(text)
    for a, b in ((":", "%3A"), (",", "%2C")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def percent(share: Column) -> Column:
    """A share as a whole percentage, ties to even."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))
