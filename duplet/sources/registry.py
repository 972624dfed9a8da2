"""The languages, as data. Adding one means adding an entry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTIFIER = "ID"
NODE_END = "#END"

# Operators that stay in a token sequence; other punctuation and keywords go.
OPERATORS = frozenset("+ - * / % ** // == != < > <= >= <=> === !== && || ! and or not in is & | ^ ~ << >> >>> = += -= *= /= %= **= //= &= |= ^= <<= >>= &&= ||= ?? ??= ?. ? .. ... ..= =>".split())
# What a literal is reduced to.
LITERALS = ("NUM", "STR", "BOOL", "NIL", "LIT")


@dataclass(frozen=True)
class Language:
    """unit_words: keywords that open a function; scope_words: those that open another named scope; truths, nils: words that are
    literals; closure: what tells a function without a name, an arrow after its parameters or what it begins with."""

    name: str
    extensions: tuple[str, ...]
    unit_words: tuple[str, ...] = ()
    scope_words: tuple[str, ...] = ()
    truths: tuple[str, ...] = ("true", "false")
    nils: tuple[str, ...] = ()
    keywords: frozenset[str] = field(default_factory=frozenset)
    line_comment: tuple[str, ...] = ("//",)
    block_comment: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: str = "\"'"
    closure: str = ""
    ends: bool = False  # blocks close with a word instead of a brace


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_C = "auto break case const continue default do else enum extern for goto if inline register return sizeof static struct switch typedef union volatile while char short int long float double void signed unsigned"
_JS = "async await break case catch class const continue debugger default delete do else export extends finally for function if import instanceof let new of return static super switch this throw try typeof var void while with yield get set"
_JAVA = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while var record"
LANGUAGES = (
    Language("c", ("c", "h"), (), ("struct", "union", "enum"), nils=("NULL",), keywords=_words(_C)),
    Language("cpp", ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), (), ("struct", "union", "enum", "class", "namespace"), nils=("NULL", "nullptr"), keywords=_words(_C + " class namespace template typename public private protected virtual override new delete using try catch throw operator friend constexpr bool this"), closure="["),
    Language("csharp", ("cs",), (), ("class", "interface", "struct", "namespace"), nils=("null",), keywords=_words(_JAVA + " namespace using string decimal bool object foreach async await override virtual internal sealed readonly out ref params get set value where yield"), closure="=>"),
    Language("go", ("go",), ("func",), ("type",), nils=("nil",), keywords=_words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"), quotes="\"'`"),
    Language("java", ("java",), (), ("class", "interface", "enum"), nils=("null",), keywords=_words(_JAVA), closure="->"),
    Language("javascript", ("js", "mjs", "cjs", "jsx"), ("function",), ("class",), nils=("null", "undefined"), keywords=_words(_JS), quotes="\"'`", closure="=>"),
    Language("php", ("php",), ("function", "fn"), ("class", "interface", "trait", "namespace", "enum"), nils=("null",), keywords=_words("abstract as break callable case catch class clone const continue declare default do echo else elseif extends final finally fn for foreach function global goto if implements include instanceof insteadof interface match namespace new print private protected public readonly require return static switch throw trait try use var while yield int string bool float array void php"), line_comment=("//", "#"), closure="fn"),
    Language("python", ("py", "pyi"), ("def",), ("class",), truths=("True", "False"), nils=("None",), line_comment=("#",), block_comment=()),
    Language("ruby", ("rb",), ("def",), ("module", "class"), nils=("nil",), keywords=_words("alias begin break case class def defined? do else elsif end ensure for if module next redo rescue retry return self super then undef unless until when while yield"), line_comment=("#",), block_comment=(("=begin", "=end"),), closure="->", ends=True),
    Language("rust", ("rs",), ("fn",), ("struct", "trait", "impl", "mod"), keywords=_words("as async await break const continue crate dyn else enum extern fn for if impl let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while"), quotes='"', closure="|"),
    Language("tsx", ("tsx",), ("function",), ("class", "interface", "namespace"), nils=("null", "undefined"), keywords=_words(_JS + " interface type namespace enum implements declare readonly private public protected abstract as"), quotes="\"'`", closure="=>"),
    Language("typescript", ("ts",), ("function",), ("class", "interface", "namespace"), nils=("null", "undefined"), keywords=_words(_JS + " interface type namespace enum implements declare readonly private public protected abstract as"), quotes="\"'`", closure="=>"),
)
EXTENSIONS = sorted(e for lang in LANGUAGES for e in lang.extensions)


def by_name(name: str) -> Language | None:
    return next((x for x in LANGUAGES if x.name == name), None)


def for_path(path: str) -> Language | None:
    ext = path.rpartition("/")[2].rpartition(".")
    return next((x for x in LANGUAGES if ext[0] and ext[2].lower() in x.extensions), None)


def is_supported(path: str) -> bool:
    return for_path(path) is not None


def registry(spark: SparkSession) -> DataFrame:
    """(language, extension), one row for each extension."""
    return spark.createDataFrame([(x.name, e) for x in LANGUAGES for e in x.extensions], "language string, extension string")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def listing() -> list[str]:
    return [f"{x.name:<12}{' '.join(x.extensions)}" for x in LANGUAGES]
