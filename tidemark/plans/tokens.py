"""A SQL tokenizer that keeps places, so statements can be rewritten without touching strings or comments."""

from __future__ import annotations

import re
from dataclasses import dataclass

_PARTS = re.compile(
    r"(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?\*/)"
    r"|(?P<string>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\")"
    r"|(?P<quoted>`(?:[^`]|``)*`)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)"
    r"|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[A-Za-z]*)|(?P<sign><=>|<>|!=|>=|<=|=>|->|\|\||::|.)",
    re.S,
)


class SqlSyntaxError(ValueError):
    """A statement of ours that does not follow its grammar."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    stop: int

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.text.lower() in words

    @property
    def name(self) -> str | None:
        """The identifier that it is, if it is one."""
        if self.kind == "word":
            return self.text
        return self.text[1:-1].replace("``", "`") if self.kind == "quoted" else None

    @property
    def value(self) -> str:
        """What a string literal holds, to the letter; else the text."""
        if self.kind != "string":
            return self.text
        quote = self.text[0]
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), self.text[1:-1].replace(quote * 2, quote))


def tokenize(sql: str, keep_all: bool = False) -> list[Token]:
    found = [Token(m.lastgroup or "sign", m[0], m.start(), m.end()) for m in _PARTS.finditer(sql)]
    return found if keep_all else [t for t in found if t.kind not in ("space", "comment")]


class Cursor:
    """Reads the tokens of one statement from left to right; a trailing semicolon is not part of it."""

    def __init__(self, sql: str):
        self.sql, self.tokens, self.at = sql, tokenize(sql), 0
        while self.tokens and self.tokens[-1].text == ";":
            self.tokens.pop()

    @property
    def end(self) -> bool:
        return self.at >= len(self.tokens)

    def peek(self, ahead: int = 0) -> Token | None:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None

    def fail(self, wanted: str) -> SqlSyntaxError:
        token = self.peek()
        where = f"at {token.text!r} (place {token.start})" if token else "at the end"
        return SqlSyntaxError(f"expected {wanted} {where}: {self.sql.strip()[:200]}")

    def looks(self, *words: str) -> bool:
        return all((t := self.peek(i)) is not None and t.is_word(w) for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        """Goes past these words if they come next."""
        if self.looks(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail(" ".join(words).upper())

    def sign(self, text: str) -> bool:
        token = self.peek()
        if token is not None and token.text == text:
            self.at += 1
            return True
        return False

    def need_sign(self, text: str) -> None:
        if not self.sign(text):
            raise self.fail(repr(text))

    def next(self, wanted: str = "more") -> Token:
        token = self.peek()
        if token is None:
            raise self.fail(wanted)
        self.at += 1
        return token

    def string(self) -> str:
        token = self.next("a quoted string")
        if token.kind != "string":
            self.at -= 1
            raise self.fail("a quoted string")
        return token.value

    def identifier(self) -> str:
        """One name; outside back quotes it may go on with ``-x``."""
        token = self.next("a name")
        if token.name is None:
            self.at -= 1
            raise self.fail("a name")
        name = token.name
        while token.kind == "word" and (dash := self.peek()) and dash.text == "-" and dash.start == token.stop and (more := self.peek(1)) and more.kind in ("word", "number") and more.start == dash.stop:
            self.at += 2
            name, token = f"{name}-{more.text}", Token("word", more.text, more.start, more.stop)
        return name

    def qualified(self) -> tuple[str, ...]:
        parts = [self.identifier()]
        while self.sign("."):
            parts.append(self.identifier())
        return tuple(parts)

    def until(self, *words: str) -> str:
        """The text up to one of these words outside all brackets (or to the end), without it."""
        depth, first = 0, self.peek()
        while (t := self.peek()) is not None and not (depth == 0 and t.is_word(*words)):
            if t.text in ")}]" and t.kind == "sign" and depth == 0:
                break
            depth += (t.text in "({[") - (t.text in ")}]") if t.kind == "sign" else 0
            self.at += 1
        last = self.tokens[self.at - 1] if self.at else None
        return self.sql[first.start : last.stop] if first and last and last.stop > first.start else ""

    def done(self) -> None:
        if not self.end:
            raise self.fail("the end")


def split_top(text: str, sign: str = ",") -> list[str]:
    """Parts of the text between signs outside brackets."""
    parts, depth, start = [], 0, 0
    for t in tokenize(text):
        if t.kind == "sign":
            depth += (t.text in "({[") - (t.text in ")}]")
            if t.text == sign and depth == 0:
                parts.append(text[start : t.start].strip())
                start = t.stop
    return [p for p in [*parts, text[start:].strip()] if p]
