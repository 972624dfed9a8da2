"""From source text to token sequences, units and identifiers.

Python goes through its own parser. Other languages go through a lexer and the nesting of their brackets or block words,
which keeps what the detectors rely on: a renamed identifier changes nothing, an operator does, literals are abstracted,
nested functions are nested units. Counts of nodes differ from those of full grammars, so thresholds for code should be
set with this provider. A provider is any object with extract(text, language, min_nodes).
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from typing import Protocol

from duplet.sources.registry import IDENTIFIER, NODE_END, OPERATORS, Language, by_name


@dataclass
class Unit:
    qualname: str
    start_line: int
    end_line: int
    node_count: int
    tokens: list[str]


@dataclass
class Extraction:
    units: list[Unit] = field(default_factory=list)
    tokens: list[tuple[str, int]] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    had_syntax_errors: bool = False


class SyntaxProvider(Protocol):
    def extract(self, text: str, language: str, min_nodes: int) -> Extraction: ...


class UnsupportedLanguage(ValueError):
    """No such language: it must not pass as a file without units."""


# ---- Python

_OPS = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.Pow: "**", ast.FloorDiv: "//", ast.LShift: "<<", ast.RShift: ">>", ast.BitOr: "|", ast.BitXor: "^", ast.BitAnd: "&", ast.MatMult: "@",
    ast.And: "and", ast.Or: "or", ast.Not: "not", ast.Invert: "~", ast.UAdd: "+", ast.USub: "-", ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "is", ast.IsNot: "is not", ast.In: "in", ast.NotIn: "not in",
}
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_NAMED = {ast.FunctionDef: ("name",), ast.AsyncFunctionDef: ("name",), ast.ClassDef: ("name",), ast.arg: ("arg",), ast.keyword: ("arg",), ast.alias: ("name", "asname"), ast.Attribute: ("attr",), ast.Name: ("id",), ast.ExceptHandler: ("name",), ast.Global: ("names",), ast.Nonlocal: ("names",), ast.ImportFrom: ("module",), ast.MatchAs: ("name",), ast.MatchStar: ("name",)}


class PythonProvider:
    def extract(self, text: str, language: str = "python", min_nodes: int = 40) -> Extraction:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            out = LexicalProvider().extract(text, "python", min_nodes)
            out.had_syntax_errors = True
            return out
        out = Extraction()
        names: set[str] = set()

        def emit(node: ast.AST, to: list[tuple[str, int]], line: int) -> int:
            """Appends node's tokens; the number of nodes."""
            line = getattr(node, "lineno", line)
            if isinstance(node, ast.expr_context):
                return 0
            if isinstance(node, ast.Constant | ast.JoinedStr):
                value = getattr(node, "value", "")
                tag = "BOOL" if isinstance(value, bool) else "NIL" if value is None else "LIT" if value is ... else "STR" if isinstance(node, ast.JoinedStr) or isinstance(value, str | bytes) else "NUM"
                to.append((tag, line))
                return 1
            for f in _NAMED.get(type(node), ()):
                value = getattr(node, f)
                names.update(x for v in ([value] if isinstance(value, str) else value or []) for x in v.split("."))
            if isinstance(node, ast.Name):
                to.append((IDENTIFIER, line))
                return 1
            if type(node) in _OPS:
                to.extend([(_OPS[type(node)], line), (NODE_END, line)])
                return 1
            to.append((type(node).__name__, line))
            to.extend((IDENTIFIER, line) for f in _NAMED.get(type(node), ()) if getattr(node, f))
            count = 1 + sum(emit(child, to, line) for child in ast.iter_child_nodes(node))
            to.append((NODE_END, getattr(node, "end_lineno", line) or line))
            return count

        def visit(node: ast.AST, scope: tuple[str, ...]) -> None:
            for child in ast.iter_child_nodes(node):
                inner = scope
                if isinstance(child, (*_FUNCTIONS, ast.ClassDef)):
                    inner = (*scope, child.name)
                if isinstance(child, _FUNCTIONS):
                    mine: list[tuple[str, int]] = []
                    count = emit(child, mine, child.lineno)
                    if count >= min_nodes:
                        out.units.append(Unit(".".join(inner), child.lineno, child.end_lineno or child.lineno, count, [t for t, _ in mine]))
                visit(child, inner)

        visit(tree, ())
        emit(tree, out.tokens, 1)
        out.identifiers = sorted(names)
        out.units.sort(key=lambda u: (u.start_line, u.end_line))
        return out


# ---- the others


_NUMBER = r"0[xX][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?\w*"
#: The arrow and the separators are no operators; they only tell where functions and expressions end.
_SYMBOLS = sorted([*(o for o in OPERATORS if not o[0].isalpha()), "->", ";", ","], key=len, reverse=True)
#: Words that begin a statement: on a new line they end an expression that has no semicolon.
_STATEMENTS = frozenset("break class const continue do export for function if import let return switch throw try var while".split())


class LexicalProvider:
    def extract(self, text: str, language: str, min_nodes: int = 40) -> Extraction:
        lang = by_name(language)
        if lang is None:
            raise UnsupportedLanguage(language)
        out = Extraction()
        places: list[tuple[int, int]] = []
        lexed = list(_lex(text, lang, out, places))
        out.identifiers = sorted({value for kind, value, _ in lexed if kind == "name"})
        spans = _indented(text, lexed) if lang.name == "python" else _worded(lexed) if lang.ends else _braced(lexed, lang, text, places)
        out.tokens = [t for kind, value, line in lexed for t in _normal(kind, value, line)]
        for name, a, z in sorted(spans, key=lambda s: (lexed[s[1]][2], lexed[s[2]][2])):
            mine = [t for kind, value, line in lexed[a : z + 1] for t, _ in _normal(kind, value, line)]
            count = sum(kind in ("name", "literal", "word", "open") for kind, _, _ in lexed[a : z + 1])
            if count >= min_nodes:
                out.units.append(Unit(name, lexed[a][2], lexed[z][2], count, mine))
        return out


def _normal(kind: str, value: str, line: int) -> list[tuple[str, int]]:
    if kind == "name":
        return [(IDENTIFIER, line)]
    if kind == "literal":
        return [(value, line)]
    if kind == "op":
        return [(value, line), (NODE_END, line)] if value in OPERATORS else []
    if kind == "open":
        return [(value, line)]
    if kind == "close":
        return [(NODE_END, line)]
    return [(value, line), (NODE_END, line)]


def _lex(text: str, lang: Language, out: Extraction, places: list[tuple[int, int]]):
    """(kind, value, line): name, word (keyword), literal (its tag), op, open or close (bracket). Adds each one's place in the text to places."""
    comments = [re.escape(a) + r".*?(?:" + re.escape(b) + r"|\Z)" for a, b in lang.block_comment] + [re.escape(x) + r"[^\n]*" for x in lang.line_comment]
    strings = [rf"{re.escape(q * 3)}.*?(?:{re.escape(q * 3)}|\Z)" for q in lang.quotes if lang.name == "python"] + [rf"{re.escape(q)}(?:\\.|[^\\{re.escape(q)}{'' if q == '`' else chr(10)}])*{re.escape(q)}" for q in lang.quotes]
    if lang.name == "rust":
        strings.append(r"'(?:\\.[^']*|[^\\'])'")
    word = r"[^\W\d]\w*[?!]?" if lang.ends else r"'?[^\W\d]\w*" if lang.name == "rust" else r"[$@]*[^\W\d]\w*"  # with Rust's lifetimes
    rule = re.compile("|".join(f"(?P<{n}>{p})" for n, p in (("c", "|".join(comments)), ("s", "|".join(strings)), ("n", _NUMBER), ("w", word), ("b", r"[(){}\[\]]"), ("o", "|".join(map(re.escape, _SYMBOLS))), ("g", r"\s+|."))), re.S)
    line = 1
    open_brackets: list[str] = []
    for m in rule.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind in "snwbo":
            places.append(m.span())
        if kind == "s":
            yield "literal", "STR", line
        elif kind == "n":
            yield "literal", "NUM", line
        elif kind == "w":
            value = value.lstrip("'")
            if value in lang.truths:
                yield "literal", "BOOL", line
            elif value in lang.nils:
                yield "literal", "NIL", line
            elif value in OPERATORS:
                yield "op", value, line
            elif value in lang.keywords or value in lang.unit_words or value in lang.scope_words:
                yield "word", value, line
            else:
                yield "name", value, line
        elif kind == "b":
            if value in "({[":
                open_brackets.append(value)
                yield "open", value, line
            else:
                if not open_brackets or open_brackets.pop() + value not in ("()", "{}", "[]"):
                    out.had_syntax_errors = True
                yield "close", value, line
        elif kind == "o":
            yield "op", value, line
        elif kind == "g" and value in "\"'`":
            out.had_syntax_errors = True
        line += value.count("\n")
    out.had_syntax_errors |= bool(open_brackets)


def _brackets(lexed: list) -> tuple[dict[int, int], dict[int, int]]:
    """Where the partner of a closing bracket opens, and where that of an opening one closes."""
    partner, opens = {}, []
    for i, (kind, _, _) in enumerate(lexed):
        if kind == "open":
            opens.append(i)
        elif kind == "close" and opens:
            partner[i] = opens.pop()
    return partner, {a: z for z, a in partner.items()}


def _closures(lexed: list, lang: Language, partner: dict[int, int], closing: dict[int, int]) -> dict[int, tuple[int, int, str]]:
    """First token of a function without a name -> (first of its body, last, name). A body is a block, or an expression that goes on to a separator or the end of its brackets."""
    n = len(lexed)
    scripts = lang.name in ("javascript", "typescript", "tsx")
    at = lambda i: lexed[i][:2] if 0 <= i < n else ("", "")
    ends = [n] * (n + 1)  # of the expression that goes on at a token
    for i in range(n - 1, -1, -1):
        kind, value, line = lexed[i]
        stop = kind == "close" or value in (";", ",") or (scripts and kind == "word" and value in _STATEMENTS and i > 0 and lexed[i - 1][2] != line)
        ends[i] = i if stop else ends[closing[i] + 1] if i in closing else ends[i + 1]

    def before_block(i: int) -> int:
        while at(i)[0] in ("name", "word") or at(i) in (("op", "->"), ("op", "<"), ("op", ">"), ("op", "&"), ("op", "*")):
            i += 1
        return i

    found = {}
    for i, (kind, value, line) in enumerate(lexed):
        begin, body, name = i, None, None
        free = at(i - 1)[0] not in ("name", "literal", "close") and at(i - 1)[1] not in ("self", "Self", "await")  # not after an operand
        if lang.closure in ("=>", "->") and kind == "op" and value == lang.closure:
            last = i - 1
            if scripts and at(last)[0] == "name" and at(last - 1) == ("close", ")"):
                last -= 1  # what it returns
            begin = partner.get(last, last)
            if at(last) != ("close", ")") and at(last)[0] != "name" or at(begin - 1)[1] in ("case", "default"):
                continue
            body = i + 1
            if lang.name == "csharp" and last != begin and at(begin - 1)[0] == "name":
                begin, name = begin - 1, at(begin - 1)[1]  # a method that is one expression
        elif lang.closure == "fn" and kind == "word" and value == "fn" and i + 1 in closing:
            arrow = before_block(closing[i + 1] + 1)
            body = arrow + 1 if at(arrow)[1] == "=>" else None
        elif lang.closure == "[" and kind == "open" and value == "[" and i in closing and free and (at(i - 1)[0] != "word" or at(i - 1)[1] == "return"):
            after = closing[i] + 1
            after = before_block(closing[after] + 1) if at(after) == ("open", "(") and after in closing else after
            body = after if at(after) == ("open", "{") else None
        elif lang.closure == "|" and kind == "op" and value in ("|", "||") and free:
            after = i
            while value == "|" and (after == i or (after < n and lexed[after][1] != "|")):
                after = closing.get(after, after) + 1
            body = before_block(after + 1) if at(after + 1) == ("op", "->") else after + 1
        if body is None or body >= n:
            continue
        last = closing[body] if at(body) == ("open", "{") and body in closing else ends[body] - 1
        if last < body:
            continue
        if name is None:
            given = begin - 2 if at(begin - 1)[1] in ("async", "move") else begin - 1
            name = at(given - 1)[1] if scripts and at(given)[1] == "=" and at(given - 1)[0] == "name" else f"<anonymous@{lexed[begin][2]}>"
        found[begin] = (body, last, name)
    return found


def _declarator(text: str, begin: int, name: int, close: int, brace: int) -> str:
    """What C and its kin declare in the head of a function: its name with qualifiers and pointers, its parameters and what follows them."""
    before = re.search(r"(?:[*&]\s*)*(?:\w+(?:<[^<>]*>)?\s*::\s*)*~?$", text[begin:name])[0]
    after = re.split(r"(?<!:):(?!:)", text[close:brace], maxsplit=1)[0]
    return before + text[name:close] + after.rstrip()


def _braced(lexed: list, lang: Language, text: str, places: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(qualified name, first, last) of functions: a name and parentheses before a brace, or a function word, or a closure."""
    spans, stack = [], []
    partner, closing = _brackets(lexed)
    closures = _closures(lexed, lang, partner, closing)
    bodies = {body for body, _, _ in closures.values()}
    for i, (kind, value, _) in enumerate(lexed):
        while stack and stack[-1][1] < i:
            stack.pop()
        if i in closures:
            _, last, name = closures[i]
            spans.append((".".join([*(n for n, _ in stack), name]), i, last))
            stack.append((name, last))
        if kind != "open" or value != "{" or i not in closing or i in bodies:
            continue
        j = i - 1
        top: list[int] = []  # outside brackets, last first
        while j >= 0 and not (lexed[j][0] == "open" and lexed[j][1] == "{") and not (lexed[j][0] == "close" and lexed[j][1] == "}") and lexed[j][1] != ";":
            top.append(j)
            j = partner[j] - 1 if j in partner else j - 1
        head = range(j + 1, i)
        names = [x for x in head if lexed[x][0] == "name"]
        word = next((x for x in head if lexed[x][0] == "word" and lexed[x][1] in lang.unit_words), None)
        scope = next((x for x in reversed(top) if lexed[x][0] == "word" and lexed[x][1] in lang.scope_words), None)
        call = next((x for x in head if lexed[x][0] == "open" and lexed[x][1] == "(" and closing.get(x, i) < i and x > 0 and lexed[x - 1][0] == "name" and (x < 2 or lexed[x - 2][1] != "new")), None)
        if call is not None and lang.name in ("c", "cpp"):
            scope = None  # struct and the like belong to a type
        control = any(lexed[x][0] == "word" and lexed[x][1] in ("if", "for", "while", "switch", "catch", "foreach", "match", "using", "synchronized", "else", "do", "try", "return") for x in head)
        begin = head[0] if len(head) else i
        name = None
        if word is not None and scope is None:
            after = next((x for x in head if x > word and lexed[x][0] != "op"), None)
            after = after if after is not None and lexed[after][0] == "name" else None
            begin = word
            if lang.name == "go":
                after = next((x - 1 for x in head if x > word and lexed[x][1] == "(" and lexed[x - 1][0] == "name"), None)
            name = lexed[after][1] if after is not None else f"<anonymous@{lexed[word][2]}>"
        elif scope is not None:
            if lexed[scope][1] == "impl":  # after its own parameters; what it is for, if it is a trait's
                angle, x = 0, scope + 1
                while x < i and (angle or lexed[x][1] == "<"):
                    angle += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(lexed[x][1], 0)
                    x += 1
                scope = next((y for y in range(x, i) if lexed[y][1] == "for"), x - 1)
            following = [x for x in names if x > scope]
            if following:
                stack.append((lexed[following[0]][1], closing[i]))
            continue
        elif call is not None and not control and not lang.unit_words or (call is not None and not control and lang.name in ("javascript", "typescript", "tsx")):
            name = lexed[call - 1][1]
            if lang.name in ("c", "cpp"):
                name = _declarator(text, places[head[0]][0], places[call - 1][0], places[closing[call]][1], places[i][0])
        if name is None:
            continue
        qualified = ".".join([*(n for n, _ in stack), name])
        spans.append((qualified, begin, closing[i]))
        stack.append((name, closing[i]))
    return spans


def _worded(lexed: list) -> list[tuple[str, int, int]]:
    """Blocks that a word closes: def ... end and the like."""
    starts = {"def", "class", "module", "begin", "case", "do", "unless", "until", "while", "for", "if"}
    spans, stack = [], []
    _, closing = _brackets(lexed)
    looped = None  # the line of a loop whose `do` is to come
    lambdas: dict[int, int] = {}  # first of a body -> its arrow
    for i, (kind, value, line) in enumerate(lexed):
        before = lexed[i - 1] if i else ("", "", 0)
        if kind == "op" and value == "->":
            j = closing.get(i + 1, i) + 1 if i + 1 < len(lexed) and lexed[i + 1][1] == "(" else i + 1
            while j < len(lexed) and lexed[j][0] == "name" or j < len(lexed) and lexed[j][1] == ",":
                j += 1
            lambdas[j] = i
        elif kind == "open" and value == "{" and i in closing and (i in lambdas or before[0] == "name" or before[1] == ")"):
            anonymous = ".".join([*(n for w, n, _ in stack if w in ("def", "class", "module")), f"<anonymous@{line}>"])
            spans.append((anonymous, i, closing[i]))
            if i in lambdas:
                spans.append((anonymous, lambdas[i], closing[i]))
        elif kind == "word" and value in starts:
            first = i == 0 or before[2] != line or before[1] in ("=", ";")
            if value in ("if", "unless", "while", "until") and not first:
                continue  # a modifier
            if value in ("while", "until", "for"):
                looped = line
            if value == "do" and looped == line:
                looped = None
                continue
            after = next((lexed[j][1] for j in range(i + 1, len(lexed)) if lexed[j][0] == "name" or lexed[j][2] != line), "")
            named = value in ("def", "class", "module") and after
            stack.append((value, after if named else f"<anonymous@{line}>", i))
        elif kind == "word" and value == "end" and stack:
            word, name, start = stack.pop()
            if word in ("def", "do"):
                scope = [n for w, n, _ in stack if w in ("def", "class", "module")]
                spans.append((".".join([*scope, name]), start, i))
                if start in lambdas:
                    spans.append((".".join([*scope, name]), lambdas[start], i))
    return spans


def _indented(text: str, lexed: list) -> list[tuple[str, int, int]]:
    """Functions of Python text that does not parse, by indentation."""
    lines = text.split("\n")
    spans = []
    for i, (kind, value, line) in enumerate(lexed):
        if kind == "word" and value == "def" and i + 1 < len(lexed):
            depth = len(lines[line - 1]) - len(lines[line - 1].lstrip())
            last = line
            for n in range(line, len(lines)):
                if lines[n].strip() and len(lines[n]) - len(lines[n].lstrip()) <= depth:
                    break
                last = n + 1 if lines[n].strip() else last
            end = max((j for j in range(i, len(lexed)) if lexed[j][2] <= last), default=i)
            spans.append((lexed[i + 1][1], i, end))
    return spans


def provider(language: str) -> SyntaxProvider:
    if by_name(language) is None:
        raise UnsupportedLanguage(language)
    return PythonProvider() if language == "python" else LexicalProvider()


