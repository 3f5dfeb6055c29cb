"""Code told from text by a stack of what is open, in one pass over a text's delimiters.

A ``Grammar`` is data: modes, kinds of tokens, and what a token does in a mode. The pass is
a small loop over the marked tokens of one text, in Python workers, to which Spark hands
only the texts that need it. Its cost is in proportion to the tokens. Nothing is matched
recursively, so code may hold literals and literals code to any depth.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Actions. ``("open", mode)`` pushes, ``("become", mode)`` replaces the innermost mode.
STAY, KEEP, CLOSE, CLOSE_TWO, ASK = ("stay", ""), ("keep", ""), ("close", ""), ("close two", ""), ("ask", "")


def opens(mode: str) -> tuple[str, str]:
    return ("open", mode)


def becomes(mode: str) -> tuple[str, str]:
    return ("become", mode)


@dataclass(frozen=True)
class Grammar:
    """How a text is read.

    modes:   what can be open; the first one is open at the start and never closed.
    code:    modes in which a reference is kept.
    tokens:  kind of each delimiter, by its exact text.
    prefixes: kinds of delimiters whose text only begins like this, tried in order.
    actions: what a kind does in a mode; it does nothing where none is given.
    asked:   what a kind with the action ASK does, by the bracket that was closed last.
    """

    modes: tuple[str, ...]
    code: tuple[str, ...]
    tokens: tuple[tuple[str, str], ...]
    prefixes: tuple[tuple[str, str], ...]
    actions: tuple[tuple[str, str, tuple[str, str]], ...]
    asked: tuple[tuple[str, tuple[str, str]], ...] = ()


# Marks around each delimiter of a text that is to be read. Noncharacters, as no text has them then.
BEGIN, END = "\uFDD0", "\uFDD1"


def _tables(grammar: Grammar, element: str | None):
    """Numbers of the kinds and of exact tokens, and what is done in each mode at each kind.

    An action is None where nothing happens, else (what, modes that end, mode that begins).
    """
    kinds = ["other", "reference", *dict.fromkeys(k for _, k in (*grammar.tokens, *grammar.prefixes))]
    kind = {k: n for n, k in enumerate(kinds)}
    mode = {m: n for n, m in enumerate(grammar.modes)}
    actions = {(m, "reference"): KEEP for m in grammar.code}
    actions |= {(m, k): a for m, k, a in grammar.actions}
    ends = {"close": 1, "become": 1, "close two": 2}

    def row(action: tuple[str, str]):
        what, begins = action
        return None if action == STAY else (what, ends.get(what, 0), mode[begins] if begins else None)

    asked = dict(grammar.asked)
    return (
        {text: kind[k] for text, k in grammar.tokens},
        [(prefix, kind[k]) for prefix, k in grammar.prefixes],
        [[row(actions.get((m, k), STAY)) for k in kinds] for m in grammar.modes],
        [row(asked.get(m, STAY)) for m in grammar.modes],
        kind["element"] if element else None,
    )


def reader(grammar: Grammar, anchor: str, element: str | None = None) -> Callable[[str], str]:
    """Reads a text whose delimiters stand between BEGIN and END; BEGIN stays before each
    reference that stands in code, and all other marks go.

    A reference begins with ``anchor``. A token that begins with ``element`` counts as an
    element only if a closing tag has its name. The function holds plain values only, so
    that Python workers need no module of this package.
    """
    exact, prefixes, actions, asked, unclosed = _tables(grammar, element)
    begin, end = BEGIN, END

    def read(text: str) -> str:
        names = None
        stack, top, closed = [0], 0, 0
        first, *pieces = text.split(begin)
        out = [first]
        for piece in pieces:
            token, _, gap = piece.partition(end)
            number = exact.get(token)
            if number is None:
                number = 0
                if len(token) > 1:
                    if token.startswith(anchor):
                        number = 1
                    else:
                        number = next((n for prefix, n in prefixes if token.startswith(prefix)), 0)
            if unclosed is not None and token.startswith(element):
                if names is None:
                    plain = text.replace(begin, "").replace(end, "")
                    names = set(re.findall(r"</([\w.:-]*+)", plain, re.ASCII))
                if token[len(element) :] not in names:
                    number = unclosed
            action = actions[top][number]
            if action is not None and action[0] == "ask":
                action = asked[closed]
            if action is not None:
                what, ends, begins = action
                if what == "keep":
                    out.append(begin)
                else:
                    if ends:
                        del stack[-ends:]
                    if begins is None:
                        closed, top = top, stack[-1]
                    else:
                        stack.append(begins)
                        top = begins
            out.append(token)
            out.append(gap)
        return "".join(out)

    return read


def read_texts(readers: dict[str, Callable[[str], str]]) -> Callable[[Column, Column], Column]:
    """Column function (language, text): the text as the reader of its language leaves it."""

    def read(languages: pa.Array, texts: pa.Array) -> pa.Array:
        pairs = zip(languages.to_pylist(), texts.to_pylist())
        return pa.array([None if text is None else readers[language](text) for language, text in pairs], pa.string())

    return F.arrow_udf(read, "string")
