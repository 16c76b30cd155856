"""Tables that statement texts read and write, by a lexer and one fold over its tokens.

Everything is a column expression: a text becomes an array of tokens without comments
and strings, and an aggregate over the array carries the parser's state.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Comments, dollar-quoted and quoted strings, quoted names, words, numbers, single characters. A
# doubled quote makes two strings that touch, so no pattern has to repeat a group.
TOKENS = (
    r"(?s)(--[^\n]*|/\*.*?(?:\*/|\z)|\$((?:[\p{L}_]\w*)?)\$.*?(?:\$\2\$|\z)|[eE]'(?:[^'\\]|\\.)*+(?:'|\z)|'[^']*(?:'|\z)"
    r"|\"[^\"]*(?:\"|\z)|[\p{L}_][\p{L}\p{N}_$]*|\p{N}[\w.]*|[^\s\w])"
)
SKIPPED = r"(?s)^(--.*|/\*.*|\$.*\$.*|[eE]?'.*)$"
WORD = r'(?s)^([\p{L}_].*|".*)$'

#: Words after which no list of tables goes on.
_ENDS = (
    "where", "group", "order", "having", "limit", "offset", "fetch", "union", "intersect", "except", "set", "values",
    "returning", "window", "for", "select", "loop", "then", "begin", "end", "when", "if", ";",
)
#: Words that stand where a table might and are none.
_NO_NAMES = (*_ENDS, "on", "as", "from", "into", "join", "using", "inner", "left", "right", "full", "cross", "natural", "insert", "update", "delete", "not", "and")
#: Functions whose arguments may hold FROM.
_FROM_INSIDE = ("extract", "trim", "substring", "overlay", "position")
#: Words before UPDATE that do not start a statement.
_NO_UPDATE = ("for", "do", "on", "key", "before", "after", "or", "of", "instead")

_FRAME = "struct<mode: string, verb: string, inside: boolean, query: string>"
_TABLE = "struct<name: string, via: string>"
_STATE = (
    f"struct<mode: string, via: string, name: string, verb: string, inside: boolean, one: string, two: string,"
    f" query: string, defines: string, queries: array<string>, frames: array<{_FRAME}>, found: array<{_TABLE}>>"
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tokens(text: Column) -> Column:
    """Tokens as written; a text too odd to be matched is NULL."""
    return F.filter(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(1)), lambda t: ~t.rlike(SKIPPED))


def _plain(token: Column) -> Column:
    return F.replace(token, F.lit('"'), F.lit(""))


def _set(state: Column, **changes) -> Column:
    """The state with some fields changed; each change is a column or a function of the state."""
    fields = ("mode", "via", "name", "verb", "inside", "one", "two", "query", "defines", "queries", "frames", "found")
    return F.struct(*[(changes[f] if f in changes else state[f]).alias(f) for f in fields])


def _named(state: Column, token: Column) -> Column:
    """Before a token: a name that it ends is noted, unless it is a function or a query of WITH."""
    ends = (state["mode"] == "name") & (token != ".")
    call = (token == "(") & state["via"].isin("from", "join", "using")
    known = F.array_contains(state["queries"], F.lower(state["name"]))
    one = F.array(F.struct(state["name"].alias("name"), state["via"].alias("via")))
    found = F.when(ends & ~call & ~known, F.concat(state["found"], one)).otherwise(state["found"])
    # A written table has no list behind it; what is read has.
    after = F.when(state["via"].isin("from", "join", "using"), "list").otherwise("")
    return _set(state, found=found, mode=F.when(ends, after).otherwise(state["mode"]))


def _defined(state: Column, token: Column, low: Column) -> Column:
    """Names of WITH queries: ``with`` asks for one, AS and a bracket open it, the bracket's end makes it known."""
    asked, head = state["defines"] == "name", state["defines"] == "head"
    word = token.rlike(WORD)
    # A star marks the queries of WITH RECURSIVE, which may name themselves.
    query = (
        F.when(low == "with", "")
        .when(asked & (low == "recursive"), "*")
        .when(asked & word, F.concat(F.regexp_extract(state["query"], r"^\*?", 0), F.lower(_plain(token))))
        .otherwise(state["query"])
    )
    defines = (
        F.when(low == "with", "name")
        .when(asked & (low == "recursive"), "name")
        .when(asked & word, "head")
        .when(head & (low == "as"), "body")
        .when(head & word & ~state["one"].isin("(", ","), "")  # WITH TIME ZONE and its like
        .when((state["defines"] == "done") & (low == ","), "name")
        .when(state["defines"] == "done", "")
        .otherwise(state["defines"])
    )
    return _set(state, query=query, defines=defines)


def _moved(state: Column, token: Column, low: Column) -> Column:
    """After a token."""
    mode, one, two = state["mode"], state["one"], state["two"]
    wanting = mode.isin("want", "dot")
    word = token.rlike(WORD)
    reads = (low == "from") & ~(state["inside"]) & ~((one == "distinct") & two.isin("is", "not"))
    via = (
        F.when(reads & (one == "delete"), "delete")
        .when(reads, "from")
        .when(low == "join", "join")
        .when((low == "using") & state["verb"].isin("delete", "merge"), "using")
        .when((low == "into") & one.isin("insert", "merge"), one)
        .when((low == "update") & ~one.isin(*_NO_UPDATE), "update")
        .when((low == "truncate") & ~one.isin(*_NO_UPDATE), "truncate")
        .when((token == ",") & (mode == "list"), "from")
    )
    opens, closes = token == "(", (token == ")") & (F.size(state["frames"]) > 0)
    own = F.when(state["defines"] == "body", F.ltrim(state["query"], F.lit("*")))
    itself = opens & own.isNotNull() & F.startswith(state["query"], F.lit("*"))
    frame = F.struct(
        F.when(wanting | (mode == "name"), "list").otherwise(mode).alias("mode"), state["verb"].alias("verb"), state["inside"].alias("inside"), own.alias("query")
    )
    outer = F.element_at(state["frames"], -1)
    ended = F.when(closes, outer["query"])
    new_mode = (
        F.when(opens, "")
        .when(closes, outer["mode"])
        .when((mode == "want") & low.isin("only", "lateral", "table"), "want")
        .when((mode == "dot") & word, "name")
        .when((mode == "want") & word & ~low.isin(*_NO_NAMES), "name")
        .when((mode == "name") & (token == "."), "dot")
        .when(via.isNotNull(), "want")
        .when(low.isin(*_ENDS), "")
        .when(mode == "want", "")
        .otherwise(mode)
    )
    name = (
        F.when((mode == "want") & word, _plain(token))
        .when((mode == "name") & (token == "."), F.concat(state["name"], F.lit(".")))
        .when((mode == "dot") & word, F.concat(state["name"], _plain(token)))
        .otherwise(state["name"])
    )
    verb = F.when(opens, "").when(closes, outer["verb"]).when(low.isin("select", "insert", "delete", "update", "merge"), low).otherwise(state["verb"])
    return _set(
        state,
        mode=new_mode,
        via=F.when(wanting, state["via"]).otherwise(F.coalesce(via, state["via"])),
        name=name,
        verb=verb,
        inside=F.when(opens, one.isin(*_FROM_INSIDE)).when(closes, outer["inside"]).when(low == "select", F.lit(False)).otherwise(state["inside"]),
        one=low,
        two=one,
        defines=F.when(opens & (state["defines"] == "body"), "").when(ended.isNotNull(), "done").otherwise(state["defines"]),
        queries=F.when(ended.isNotNull(), F.concat(state["queries"], F.array(ended)))
        .when(itself, F.concat(state["queries"], F.array(own)))
        .otherwise(state["queries"]),
        frames=F.when(opens, F.concat(state["frames"], F.array(frame)))
        .when(closes, F.slice(state["frames"], 1, F.size(state["frames"]) - 1))
        .otherwise(state["frames"]),
    )


def statement_tables(text: Column) -> Column:
    """Tables of a statement in order, each as (name, via): from, join, using, insert, delete, update, merge or truncate.

    Comments, strings, table functions and queries named by WITH are no tables; FROM inside
    EXTRACT and its like, and IS DISTINCT FROM, name none. Quotes of names are left out.
    """
    none = F.lit("")
    start = F.struct(
        none.alias("mode"), none.alias("via"), none.alias("name"), none.alias("verb"), F.lit(False).alias("inside"), none.alias("one"), none.alias("two"),
        none.alias("query"), none.alias("defines"), F.array().cast("array<string>").alias("queries"),
        F.array().cast(f"array<{_FRAME}>").alias("frames"), F.array().cast(f"array<{_TABLE}>").alias("found"),
    ).cast(_STATE)

    def step(state, token):
        return _let(
            F.lower(token),
            lambda low: _let(
                _named(state, token), lambda a: _let(_defined(a, token, low), lambda b: _moved(b, token, low).cast(_STATE))
            ),
        )

    # A last mark ends a name that stands at the end.
    return F.aggregate(F.concat(_tokens(text), F.array(F.lit(";"))), start, step, lambda state: state["found"])
