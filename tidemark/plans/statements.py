"""The statements that Spark's own grammar lacks, as plain records, and their parser.

Keywords are taken in any case, white space is free, a trailing semicolon is fine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from tidemark.plans.tokens import Cursor, split_top, tokenize


@dataclass(frozen=True)
class CopyInto:
    table: tuple[str, ...]
    location: str
    file_format: str
    select: str | None = None  # what stands before FROM inside the braces
    rest: str = ""  # what follows the location inside the braces
    pattern: str | None = None
    files: tuple[str, ...] = ()
    format_options: dict[str, str] = field(default_factory=dict)
    copy_options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class GenerateLog:
    file_format: str
    table: tuple[str, ...] | None = None
    location: str | None = None


@dataclass(frozen=True)
class ShowCatalogs:
    pass


@dataclass(frozen=True)
class Clause:
    """One WHEN of a MERGE. ``kind``: matched, absent (from the target) or orphan (not in the source)."""

    kind: str
    condition: str | None
    action: str  # update, delete or insert
    columns: tuple[str, ...] = ()
    values: tuple[str, ...] = ()  # no values: all columns of the source


@dataclass(frozen=True)
class Merge:
    table: tuple[str, ...]
    alias: str
    source: str
    source_alias: str
    condition: str
    clauses: tuple[Clause, ...]


@dataclass(frozen=True)
class Update:
    table: tuple[str, ...]
    alias: str
    assignments: tuple[tuple[str, str], ...]
    condition: str | None


@dataclass(frozen=True)
class Delete:
    table: tuple[str, ...]
    alias: str
    condition: str | None


@dataclass(frozen=True)
class Insert:
    table: tuple[str, ...]
    query: str
    overwrite: bool = False
    partition: tuple[tuple[str, str | None], ...] = ()
    if_not_exists: bool = False
    columns: tuple[str, ...] = ()
    by_name: bool = False


def options(c: Cursor) -> dict[str, str]:
    """('k' = 'v', k.x = v, ...); values keep their white space."""
    out: dict[str, str] = {}
    c.need_sign("(")
    while not c.sign(")"):
        token = c.next("an option")
        key = token.value
        while token.kind != "string" and c.sign("."):
            key += f".{c.next('a name').text}"
        c.need_sign("=")
        value = c.next("a value")
        out[key] = value.value
        if not c.sign(","):
            c.need_sign(")")
            break
    return out


def copy_into(c: Cursor) -> CopyInto:
    c.need("copy", "into")
    table = c.qualified()
    if len(table) not in (2, 3):
        raise c.fail("a table name of two or three parts")
    c.need("from")
    select, rest = None, ""
    if c.sign("{"):
        c.need("select")
        select = c.until("from")
        c.need("from")
        location = c.string()
        rest = c.until()
        c.need_sign("}")
    else:
        location = c.string()
    c.need("fileformat")
    c.need_sign("=")
    token = c.next("a format")
    file_format, pattern, files = token.value.lower(), None, ()
    if c.take("pattern"):
        c.need_sign("=")
        pattern = c.string()
    if c.take("files"):
        c.need_sign("=")
        c.need_sign("(")
        names = [c.string()]
        while c.sign(","):
            names.append(c.string())
        c.need_sign(")")
        files = tuple(names)
    found = {}
    for word in ("format_options", "copy_options"):
        if c.take(word):
            c.sign("=")
            found[word] = options(c)
    c.done()
    return CopyInto(table, location, file_format, select, rest, pattern, files, **found)


def generate_log(c: Cursor) -> GenerateLog:
    c.need("generate", "deltalog", "for")
    table = location = None
    if c.take("table"):
        table = c.qualified()
    else:
        c.need("location")
        location = c.string()
    c.need("using")
    file_format = c.next("a format").value.lower()
    c.done()
    return GenerateLog(file_format, table, location)


def alias(c: Cursor, default: str) -> str:
    if c.take("as"):
        return c.identifier()
    token = c.peek()
    if token is not None and token.name and not token.is_word("using", "on", "set", "where", "when"):
        return c.identifier()
    return default


def assignments(text: str) -> tuple[tuple[str, str], ...]:
    out = []
    for part in split_top(text):
        equals = next(t for t in tokenize(part) if t.text == "=")
        out.append((part[: equals.start].strip().rsplit(".", 1)[-1].strip("` "), part[equals.stop :].strip()))
    return tuple(out)


def merge(c: Cursor) -> Merge:
    c.need("merge", "into")
    table = c.qualified()
    name = alias(c, table[-1])
    c.need("using")
    if c.sign("("):
        source = f"({c.until()})"
        c.need_sign(")")
        source_alias = alias(c, "source")
    else:
        first = c.peek()
        parts = c.qualified()
        source = c.sql[first.start : c.tokens[c.at - 1].stop]
        source_alias = alias(c, parts[-1])
    c.need("on")
    condition = c.until("when")
    clauses = []
    while c.take("when"):
        if c.take("matched"):
            kind = "matched"
        else:
            c.need("not", "matched")
            kind = "orphan" if c.take("by", "source") else "absent"
            c.take("by", "target")
        extra = c.until("then") if c.take("and") else None
        c.need("then")
        if c.take("delete"):
            clauses.append(Clause(kind, extra, "delete"))
        elif c.take("update"):
            if c.sign("*") or (c.take("set") and c.sign("*")):
                clauses.append(Clause(kind, extra, "update"))
            else:
                pairs = assignments(c.until("when"))
                clauses.append(Clause(kind, extra, "update", tuple(k for k, _ in pairs), tuple(v for _, v in pairs)))
        else:
            c.need("insert")
            if c.sign("*"):
                clauses.append(Clause(kind, extra, "insert"))
            else:
                c.need_sign("(")
                columns = tuple(p.strip("` ") for p in split_top(c.until()))
                c.need_sign(")")
                c.need("values")
                c.need_sign("(")
                values = tuple(split_top(c.until()))
                c.need_sign(")")
                clauses.append(Clause(kind, extra, "insert", columns, values))
    c.done()
    for k in clauses:
        if (k.kind == "absent") != (k.action == "insert") or (k.kind == "orphan" and k.action == "update" and not k.values):
            raise c.fail(f"another action than {k.action.upper()} where rows are {k.kind}")
    return Merge(table, name, source, source_alias, condition, tuple(clauses))


def update(c: Cursor) -> Update:
    c.need("update")
    table = c.qualified()
    name = alias(c, table[-1])
    c.need("set")
    pairs = assignments(c.until("where"))
    condition = c.until() if c.take("where") else None
    c.done()
    return Update(table, name, pairs, condition)


def delete(c: Cursor) -> Delete:
    c.need("delete", "from")
    table = c.qualified()
    name = alias(c, table[-1])
    condition = c.until() if c.take("where") else None
    c.done()
    return Delete(table, name, condition)


def insert(c: Cursor) -> Insert:
    c.need("insert")
    overwrite = c.take("overwrite")
    if not overwrite:
        c.need("into")
    c.take("table")
    table = c.qualified()
    partition: list[tuple[str, str | None]] = []
    columns: tuple[str, ...] = ()
    if c.take("partition"):
        c.need_sign("(")
        for part in split_top(c.until()):
            name, _, value = part.partition("=")
            partition.append((name.strip().strip("`"), value.strip() or None))
        c.need_sign(")")
    missing = c.take("if", "not", "exists")
    by_name = c.take("by", "name")
    token = c.peek()
    if token is not None and token.text == "(" and not ((t := c.peek(1)) and t.is_word("select", "with", "values", "from", "table")):
        c.sign("(")
        columns = tuple(p.strip("` ") for p in split_top(c.until()))
        c.need_sign(")")
    first = c.peek()
    if first is None:
        raise c.fail("a query")
    query = c.sql[first.start : c.tokens[-1].stop]
    return Insert(table, query, overwrite, tuple(partition), missing, columns, by_name)


def parse(sql: str):
    """Our record of the statement, or None if it is Spark's alone."""
    c = Cursor(sql)
    for words, rule in ((("copy", "into"), copy_into), (("generate", "deltalog"), generate_log), (("merge", "into"), merge), (("update",), update), (("delete", "from"), delete), (("insert",), insert)):
        if c.looks(*words):
            return rule(c)
    if c.looks("show", "catalogs") and len(c.tokens) == 2:
        return ShowCatalogs()
    return None
