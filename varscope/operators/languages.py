"""What a language looks like to the extractor.

A language is data: how its references start, how comments and strings are skipped,
and how the arguments after a reference are read. All regexes are Java regexes with
possessive repetition, so a long literal neither backtracks nor recurses.
"""

from __future__ import annotations

from dataclasses import dataclass

from varscope.functions.text import WS, WS_INLINE
from varscope.operators.stack import ASK, CLOSE, CLOSE_TWO, Grammar, becomes, opens

# Marks written into a text: START before a reference, END after a tag. Noncharacters
# of three UTF-8 bytes, so replacing one that a file already holds keeps byte columns.
START, END = "\uFDD0", "\uFDD1"
# Put before a delimiter that opens something at its place, or does under a condition.
OPENS, ASKS = "\uFDD8", "\uFDD9"


@dataclass(frozen=True)
class LexedLanguage:
    """A language whose references are calls or member accesses outside comments/strings.

    anchor:        first identifier of every reference.
    head:          start of a reference; must capture the anchor as its only group.
    skip:          comments and plain string literals.
    trap:          found in every text in which code stands in literals, or a delimiter's
                   meaning depends on its place; only such texts are read by a stack.
    openers:       (pattern, mark) put before a delimiter, for what its place tells.
    delimiter:     references and everything that opens or closes something.
    wide_opener, wide_delimiter: the same with brackets, for texts in which ASKS is put.
    grammar:       what the delimiters do.
    element:       prefix of delimiters that count only if a closing tag has their name.
    call:          read at a reference; always matches there. Groups: see the next fields.
    """

    name: str
    extensions: tuple[str, ...]
    guards: tuple[str, ...]
    anchor: str
    head: str
    skip: str
    call: str
    key_groups: tuple[int, ...]
    default_group: int | None = None
    other_argument_group: int | None = None
    trap: str | None = None
    openers: tuple[tuple[str, str], ...] = ()
    delimiter: str | None = None
    wide_opener: str | None = None
    wide_delimiter: str | None = None
    grammar: Grammar | None = None
    element: str | None = None

    @property
    def token(self) -> str:
        return f"{self.head}|{self.skip}"


@dataclass(frozen=True)
class LineLanguage:
    """A language read line by line: names that a line reads, or names that it declares.

    references:  patterns looked for anywhere in a line; group 1 is a name it reads.
    assigned:    pattern over the whole text; the names of its group 1 are the file's own ...
    exported:    ... unless this pattern finds them too.
    specials:    names that never count.
    declaration: a whole line that declares a name; its groups are the keyword, the name,
                 the sign before a value, the value after the sign, the value without one.
                 The first declaration of a name counts.
    valued_by:   (start of a keyword, "text" or "sign"): whether the name has a value if there
                 is text, or as soon as there is a sign.
    """

    name: str
    extensions: tuple[str, ...]
    guards: tuple[str, ...]
    filename_prefixes: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    assigned: str | None = None
    exported: str | None = None
    specials: tuple[str, ...] = ()
    declaration: str | None = None
    valued_by: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if bool(self.references) == bool(self.declaration):
            raise ValueError(f"{self.name}: a line language has either references or a declaration")


_DOUBLE = r'"(?:[^"\\\n]++|\\[\s\S])*+"'
_SINGLE = r"'(?:[^'\\\n]++|\\[\s\S])*+'"
_C_COMMENT = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"

_PY_TRIPLE = (
    r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+(?:""")?' r"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+(?:''')?"
)
_PY_LITERAL = rf"[A-Za-z]{{0,2}}(?:{_PY_TRIPLE}|{_DOUBLE}|{_SINGLE})"
_PY_GAP = r"(?:\s++|\\\n|#[^\n]*+)*+"

# Prefixes of literals with code in them.
_PY_PREFIXES = tuple(
    a + f + b for f in "fFtT" for a in ("", "r", "R") for b in ("", "r", "R") if not (a and b)
)
_PY_QUOTES = {"single": "'", "double": '"', "triple single": "'''", "triple double": '"""'}
_PY_CODE = ("code", "field", "bracket")


def _python_actions():
    for mode in _PY_CODE:
        yield mode, "hash", opens("comment")
        for quote in _PY_QUOTES:
            yield mode, quote, opens(quote)
            yield mode, f"f {quote}", opens(f"f {quote}")
    yield "comment", "line", CLOSE
    for quote in _PY_QUOTES:
        for literal in (quote, f"f {quote}"):
            # a triple quote closes a plain literal, and opens and closes an empty one
            for closing in (quote, f"triple {quote}"):
                yield literal, closing, CLOSE
                yield literal, f"f {closing}", CLOSE
            if "triple" not in quote:
                yield literal, "line", CLOSE
        yield f"f {quote}", "brace", opens("field")
        yield f"f {quote}", "doubled brace", opens("doubled")
    for kind in ("brace", "doubled brace"):
        yield "doubled", kind, CLOSE
    for mode in ("field", "bracket"):
        for kind in ("brace", "doubled brace", "bracket"):
            yield mode, kind, opens("bracket")
    yield "field", "brace end", CLOSE
    yield "field", "colon", becomes("format")
    yield "format", "brace", opens("field")
    yield "format", "brace end", CLOSE
    for kind in ("brace end", "bracket end"):
        yield "bracket", kind, CLOSE


_PY_GRAMMAR = Grammar(
    modes=(*_PY_CODE, "format", "doubled", "comment", *_PY_QUOTES, *(f"f {q}" for q in _PY_QUOTES)),
    code=_PY_CODE,
    tokens=(
        *((text, kind) for kind, text in _PY_QUOTES.items()),
        *((p + text, f"f {kind}") for kind, text in _PY_QUOTES.items() for p in _PY_PREFIXES),
        ("{", "brace"), (OPENS + "{", "doubled brace"), ("}", "brace end"), ("(", "bracket"), ("[", "bracket"),
        (")", "bracket end"), ("]", "bracket end"), (":", "colon"), ("#", "hash"), ("\n", "line"),
    ),
    prefixes=(),
    actions=tuple(_python_actions()),
)
_PY_HEAD = r"(?<![\w.])(os)\s*+\.\s*+(?:getenv\s*+\(|environ\s*+\.\s*+get\s*+\(|environ\s*+\[)"
_PY_F = r"(?:(?<!\w)[rR]?[fFtT][rR]?)"

PYTHON = LexedLanguage(
    name="python",
    extensions=(".py", ".pyw"),
    guards=("getenv", "environ"),
    anchor="os",
    head=_PY_HEAD,
    skip=rf"#[^\n]*+|{_PY_TRIPLE}|{_DOUBLE}?|{_SINGLE}?",
    trap=rf"{_PY_F}[\"']",
    openers=((r"\{(?=\{)", OPENS),),
    delimiter=(
        rf"(?=[o\\{OPENS}{{}}()\[\]:#\n\"'rRfFtT])(?:(?={_PY_HEAD})os|\\[\s\S]|{_PY_F}?(?:\"\"\"|'''|[\"'])"
        rf"|{OPENS}?\{{|[}}()\[\]:#\n])"
    ),
    grammar=_PY_GRAMMAR,
    call=(
        rf"{START}os\s*+\.\s*+(?:getenv|environ(?:\s*+\.\s*+get)?+)\s*+[(\[]"
        # Arguments are only looked at, so references nested in them match on their own.
        rf"(?=(?:{_PY_GAP}({_PY_LITERAL})(?={_PY_GAP}[,)\]])"
        rf"(?:{_PY_GAP},{_PY_GAP}(?:({_PY_LITERAL})(?={_PY_GAP}[,)])|([^\s)\]])))?)?)"
    ),
    key_groups=(1,),
    default_group=2,
    other_argument_group=3,
)

# A spread (`...process.env`) is a reference, a member (`x.process.env`) is not.
_JS_HEAD = (
    r"(?<![\w$])(?<!(?<!\.\.)\.)(process)\s*+(?:\?\s*+)?\.\s*+env(?![\w$])\s*+"
    r"(?:(?:\?\s*+)?\.\s*+(?=[\p{L}_$])|\[)"
)
# Words after which an expression begins.
_JS_WORDS = "return|typeof|case|in|of|delete|void|throw|new|do|else|await|yield|instanceof|from|import|export|default|as"
# A quote right after a word is text (`Don't`), unless an expression begins there.
_JS_CODE_WORD = rf"(?:(?<![\p{{L}}\p{{N}}])|(?<=(?<![\w$])(?:{_JS_WORDS})))"
_JS_AFTER_WORD = rf"(?<=(?<![\w$.])(?:{_JS_WORDS})\s{{0,9}})|(?<=^\s{{0,9}})"
# Where an operand is expected: after most operators, but not after `++` and `--`.
_JS_OPERAND = rf"(?:(?<=[(,=:\[!&|?;{{*%~^>\n]\s{{0,9}})|(?<=(?<!\+)\+\s{{0,9}})|(?<=(?<!-)-\s{{0,9}})|{_JS_AFTER_WORD})"
_JS_OBJECT_PLACE = rf"(?:(?<=[(,=:\[!&|?+\-*%~^]\s{{0,9}})|(?<=(?<![\w$.])(?:return|typeof|in|of|void|throw|new|await|yield|default)\s{{0,9}}))"
_JS_MARKUP_PLACE = rf"(?:(?<=[(,=:\[!&|?;{{}}>\n]\s{{0,9}})|{_JS_AFTER_WORD})"
# A regex literal closes on its line; `/>` is one right after an operator only.
_JS_REGEX = r"/(?![/*])(?:(?!>)|(?<=[(,=:!&|?\[]/))(?=(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/)"
_JS_TAG_NAME = r"[A-Za-z][\w.:-]*+"
# Attributes, with code three braces deep, up to the end of an element without content.
_JS_EMPTY_ELEMENT = (
    rf"<(?={_JS_TAG_NAME}(?:[^<>{{}}\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+'"
    r"|\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\})*+/>)"
)
_JS_ELEMENT = rf"<(?=>|{_JS_TAG_NAME}[\s/>])(?!\w++\s++extends\b)"

_JS_CODE = ("code", "block", "object", "embedded", "paren", "condition")
_JS_QUOTED = {"tick": "`", "double": '"', "single": "'"}


def _javascript_actions():
    for mode in _JS_CODE:
        yield mode, "brace", opens("block")
        yield mode, "dollar", opens("block")
        yield mode, "object", opens("object")
        yield mode, "paren", opens("paren")
        yield mode, "condition", opens("condition")
        yield mode, "comment line", opens("comment line")
        yield mode, "comment open", opens("comment")
        yield mode, "slash open", opens("regex")
        yield mode, "slash asked", ASK
        yield mode, "element open", opens("tag")
        for quote in _JS_QUOTED:
            yield mode, f"{quote} open", opens(quote)
        if mode in ("block", "object", "embedded"):
            yield mode, "brace end", CLOSE
        if mode in ("paren", "condition"):
            yield mode, "paren end", CLOSE
    for quote in _JS_QUOTED:
        for kind in (quote, f"{quote} open"):
            yield quote, kind, CLOSE
            if quote != "tick":
                yield "tag", kind, opens(f"{quote} value")
                yield f"{quote} value", kind, CLOSE
        if quote != "tick":
            yield quote, "line", CLOSE
    yield "tick", "dollar", opens("embedded")
    yield "comment line", "line", CLOSE
    yield "comment", "comment end", CLOSE
    for kind in ("slash", "slash open", "slash asked", "comment line", "comment open", "comment end", "element end", "closing", "line"):
        yield "regex", kind, CLOSE
    yield "regex", "square", opens("class")
    yield "class", "square end", CLOSE
    yield "class", "line", CLOSE_TWO
    for mode in ("tag", "content"):
        for kind in ("brace", "object", "dollar"):
            yield mode, kind, opens("embedded")
    yield "tag", "element end", CLOSE
    yield "tag", "greater", becomes("content")
    for kind in ("element", "element open"):
        yield "content", kind, opens("tag")
    yield "content", "closing", becomes("closing tag")
    yield "closing tag", "greater", CLOSE


_JS_GRAMMAR = Grammar(
    modes=(
        *_JS_CODE, *_JS_QUOTED, "comment line", "comment", "regex", "class", "tag", "content", "closing tag",
        "double value", "single value",
    ),
    code=_JS_CODE,
    tokens=(
        ("{", "brace"), (OPENS + "{", "object"), ("${", "dollar"), ("}", "brace end"), ("[", "square"), ("]", "square end"),
        ("(", "paren"), (OPENS + "(", "condition"), (")", "paren end"), ("\n", "line"), ("//", "comment line"),
        (OPENS + "/*", "comment open"), ("*/", "comment end"), (f"*{OPENS}/", "comment end"), ("/", "slash"),
        (OPENS + "/", "slash open"), (ASKS + "/", "slash asked"), ("/>", "element end"), (">", "greater"), ("</", "closing"),
        *((text, kind) for kind, text in _JS_QUOTED.items()),
        *((OPENS + text, f"{kind} open") for kind, text in _JS_QUOTED.items()),
    ),
    prefixes=((OPENS + "<", "element open"), (ASKS + "<", "element open"), ("<", "element")),
    actions=tuple(_javascript_actions()),
    # after the bracket of `if (...)` and after a block, a slash begins a regex literal
    asked=(("condition", opens("regex")), ("block", opens("regex"))),
)


def _javascript_delimiter(brackets: str) -> str:
    return (
        rf"(?=[p\\/*\"'`${{}}<>{brackets}\[\]\n{OPENS}{ASKS}])(?:(?=process){_JS_HEAD}|\\[\s\S]|{OPENS}/\*|\*{OPENS}?/"
        rf"|(?=//)(?<!(?:https?|wss?|ftp|file):)//|/>|[{OPENS}{ASKS}]?[\"'`/{{]|\$\{{"
        rf"|[{OPENS}{ASKS}]?<(?:{_JS_TAG_NAME}|(?=>))|</|{OPENS}?[{brackets}\[\]}}>\n])"
    )


JAVASCRIPT = LexedLanguage(
    name="javascript",
    extensions=(".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx"),
    guards=("process",),
    anchor="process",
    head=_JS_HEAD,
    skip=rf"{_C_COMMENT}|{_DOUBLE}|{_SINGLE}",
    # A template, markup, or a slash that is no comment's.
    trap=r"`|</|/>|(?<![/*])/(?![/*])",
    openers=(
        # What is looked for stands first, in every choice, so that nothing is looked behind at other characters.
        # An opening delimiter has its closing one: on the line for quotes and regex literals.
        (
            rf"(?=[\"'`/<{{])(?<!\\)(?:(?=[\"']){_JS_CODE_WORD}(?:\"(?=(?:[^\"\\\n]|\\[\s\S])*+\")|'(?=(?:[^'\\\n]|\\[\s\S])*+'))"
            rf"|(?=/[^/*]){_JS_OPERAND}{_JS_REGEX}|`(?=[^`]*+`)|/\*(?=(?:[^*]++|\*(?!/))*+\*/)"
            rf"|(?=\{{){_JS_OBJECT_PLACE}\{{|(?=<[A-Za-z]){_JS_MARKUP_PLACE}{_JS_EMPTY_ELEMENT})",
            OPENS,
        ),
        (rf"(?=[/<])(?<!\\)(?:(?=/[^/*])(?<=[)}}]\s{{0,9}}){_JS_REGEX}|(?=<[A-Za-z>]){_JS_MARKUP_PLACE}{_JS_ELEMENT})", ASKS),
    ),
    wide_opener=r"(?=\()(?<=(?<![\w$.])(?:if|while|for|with)\s{0,9})\(",
    delimiter=_javascript_delimiter(""),
    wide_delimiter=_javascript_delimiter("()"),
    grammar=_JS_GRAMMAR,
    element=ASKS + "<",
    call=(
        rf"{START}process\s*+(?:\?\s*+)?\.\s*+env\s*+(?:(?:\?\s*+)?\.\s*+([\p{{L}}_$][\p{{L}}\p{{N}}_$]*+)"
        rf"|\[(?:\s*+({_DOUBLE}|{_SINGLE})\s*+\])?)"
    ),
    key_groups=(1, 2),
)

GO = LexedLanguage(
    name="go",
    extensions=(".go",),
    guards=("Getenv", "LookupEnv"),
    anchor="os",
    head=r"(?<![\w.])(os)\s*+\.\s*+(?:Getenv|LookupEnv)\s*+\(",
    skip=rf"{_C_COMMENT}|{_DOUBLE}?|`[^`]*+`?|{_SINGLE}?",
    call=(
        rf"{START}os\s*+\.\s*+(?:Getenv|LookupEnv)\s*+\("
        rf"(?:\s*+({_DOUBLE})(?=\s*+(?:[,)]|/[/*])))?"
    ),
    key_groups=(1,),
)

_NAME = "[A-Z_][A-Z0-9_]*+"
_WORD_END = r"(?![\p{L}\p{N}_])"
# One-character names that are shell specials.
SHELL_SPECIAL_NAMES = ("$", "?", "!", "@", "*", "#", "-", "_") + tuple("0123456789")

SHELL = LineLanguage(
    "shell",
    (".sh", ".bash", ".zsh", ".ksh", ".fish"),
    ("$",),
    references=(rf"\$\{{#?({_NAME})[^}}\n]*+\}}", rf"\$({_NAME}){_WORD_END}"),
    # An assignment whose right-hand side (up to a comment) does not read the same name.
    assigned=rf"(?md)^[{WS_INLINE}]*+({_NAME})=(?![^#\n]*\$\{{?\1{_WORD_END})",
    exported=rf"(?md)^[{WS_INLINE}]*+export[{WS_INLINE}]++({_NAME})(?=[={WS}#]|$)",
    specials=SHELL_SPECIAL_NAMES,
)
# Keyword, name, then `=value` or (ENV only) a blank and a value.
DOCKER = LineLanguage(
    "docker",
    (),
    ("ENV", "ARG"),
    filename_prefixes=("Dockerfile", "dockerfile"),
    declaration=(
        rf"[{WS_INLINE}]*+(ENV|ARG(?=[{WS_INLINE}]++{_NAME}(?:=|[{WS_INLINE}]*+$)))"
        rf"[{WS_INLINE}]++({_NAME})(?:(=)([^\n]*+)|[{WS_INLINE}]([^\n]*+))?$"
    ),
    valued_by=(("ENV", "text"), ("ARG", "sign")),
)

DEFAULT_LANGUAGES = (PYTHON, JAVASCRIPT, GO, SHELL, DOCKER)
Language = LexedLanguage | LineLanguage
