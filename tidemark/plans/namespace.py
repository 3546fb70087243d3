"""Three-part names over the session catalog.

``cat.db.t`` is table ``t`` of the session database ``cat__db``, which lies at ``<warehouse>/cat.cat/db.db``.
Names are rewritten in the statement's tokens before Spark sees it: strings, comments and other names stay
as they are, and so do columns with all their parts (``cat.db.t.c`` becomes ``cat__db.t.c``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from tidemark.plans.tokens import Token, tokenize

SESSION = "spark_catalog"


def database(catalog: str, namespace: str) -> str:
    return namespace if catalog == SESSION else f"{catalog}__{namespace}"


def quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def chains(sql: str) -> list[list[Token]]:
    """Runs of names joined by dots."""
    tokens, out, k = tokenize(sql), [], 0
    while k < len(tokens):
        if tokens[k].name is None or (k and tokens[k - 1].text == "."):
            k += 1
            continue
        run = [tokens[k]]
        while k + 2 < len(tokens) and tokens[k + 1].text == "." and tokens[k + 2].name is not None:
            run.append(tokens[k + 2])
            k += 2
        out.append(run)
        k += 1
    return out


#: Words after which a table is named, and words that end the clause in which tables are listed.
TABLE_FOLLOWS = ("from", "join", "into", "update")
LIST_ENDS = ("select", "where", "group", "order", "having", "limit", "union", "intersect", "except", "set", "values", "window", "sort", "cluster", "distribute", "qualify")
NO_ALIAS = (*LIST_ENDS, "join", "inner", "left", "right", "full", "cross", "anti", "semi", "natural", "on", "using", "when", "tablesample", "lateral", "version", "timestamp", "for", "pivot", "unpivot", "minus", "outer", "with")
QUERIES = ("select", "with", "from", "insert", "create", "explain", "merge", "update", "delete", "cache")


def table_places(sql: str) -> set[int] | None:
    """Where names of tables start in a query; None for a statement in which any name may be a table's.

    A FROM in brackets that hold no SELECT belongs to a function, as in ``extract(year FROM x)``. Names that
    the query itself defines (WITH) are left out.
    """
    tokens = tokenize(sql)
    first = next((t for t in tokens if t.text != "("), None)
    if first is None or not first.is_word(*QUERIES):
        return None
    own = {tokens[k].name.lower() for k in range(1, len(tokens) - 2) if tokens[k].name and tokens[k + 1].is_word("as") and tokens[k + 2].text == "(" and (tokens[k - 1].is_word("with", "recursive") or tokens[k - 1].text in (",", ")"))}
    levels, places, wanted = [[True, False]], set(), False  # per bracket: a FROM may list tables; it is listing them
    for k, t in enumerate(tokens):
        if t.text == "(":
            levels.append([False, False])
            wanted = False
        elif t.text == ")":
            levels = levels[:-1] or [[True, False]]
            wanted = False
        elif t.is_word("select"):
            levels[-1] = [True, False]
            wanted = False
        elif t.is_word(*TABLE_FOLLOWS) and (k == 0 or tokens[k - 1].text != "."):
            listing = levels[-1][0] or t.is_word("join")
            levels[-1][1] = wanted = listing
        elif first.is_word("merge") and t.is_word("using"):
            wanted = True
        elif t.is_word(*LIST_ENDS) and (k == 0 or tokens[k - 1].text != "."):
            levels[-1][1] = wanted = False
        elif t.text == ",":
            wanted = levels[-1][1]
        else:
            if wanted and t.name is not None and not t.is_word("lateral", "table"):
                alone = k + 1 >= len(tokens) or tokens[k + 1].text not in (".", "(")
                if not (alone and t.name.lower() in own):
                    places.add(t.start)
            wanted = False
    return places


def rewritten(sql: str, catalogs: set[str], special: Callable[[tuple[str, ...]], str | None] = lambda names: None) -> str:
    """The statement with names of known catalogs mapped. ``special`` may map the name of a table otherwise:
    it gets the parts of every name in the place of a table, at most three, and returns SQL for them or None.
    A column that is told with the parts of such a table follows it; any other ``alias.column`` stays."""
    out, at = [], 0
    known = {c.lower(): c for c in catalogs}
    places, runs = table_places(sql), chains(sql)
    found: dict[tuple[str, ...], str] = {}
    for run in runs:
        names = tuple(t.name or "" for t in run)
        if len(names) <= 3 and (run[0].start in places if places is not None else len(names) > 1) and names not in found:
            new = special(names)
            if new is not None:
                found[names] = new
    last = Counter(names[-1].lower() for names in found)
    tokens = tokenize(sql)
    at_start = {t.start: k for k, t in enumerate(tokens)}
    for run in runs:
        names = tuple(t.name or "" for t in run)
        used = new = None
        here = places is None or run[0].start in places
        for n in range(min(3, len(names)), 0, -1):
            if names[:n] in found and (n == len(names) if here else n > 1 and n < len(names)):
                used, new = n, found[names[:n]]
                if places is not None and last[names[n - 1].lower()] == 1:  # its columns may be told by its own name
                    after = at_start[run[-1].start] + 1
                    alias = after < len(tokens) and (tokens[after].is_word("as") or tokens[after].name is not None and not tokens[after].is_word(*NO_ALIAS))
                    if not here:
                        new = quoted(names[n - 1])
                    elif not alias and not tokens[at_start[run[0].start] - 1].is_word("into", "update"):
                        new = f"{new} AS {quoted(names[n - 1])}"
                break
        if used is None and len(names) >= 2 and names[0].lower() in known:
            used, new = 2, quoted(database(known[names[0].lower()], names[1]))
        if used:
            out += [sql[at : run[0].start], new]
            at = run[used - 1].stop
    return "".join([*out, sql[at:]])
