"""Statements of SQL in text columns: tokens by built-in functions, and what is read from them.

Tokens are cut by one pattern that covers every character, so the texts of all tokens in a row are the statement again.
Quoted texts, quoted names and comments are tokens of their own, and nothing inside them is taken for a word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quoted text, quoted name, comment, word, parameter, number, white space, signs of two characters, any other character.
TOKEN = r"""(?s)'(?:[^']|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z0-9_]*|:[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|\s+|<=|>=|<>|!=|==|\|\||."""
#: Words that wrap a value without changing which column it is held against.
WRAPS = ["lower", "upper", "trim"]
COMPARES = ["=", "==", "like", "in"]
ENDS = ["order", "group", "limit"]


def _named(**fields: Column) -> Column:
    """A struct whose names hold wherever it is nested."""
    return F.named_struct(*(x for name, c in fields.items() for x in (F.lit(name), c)))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a value that is read more than once; the value is worked out once for the row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _kind(t: Column) -> Column:
    def of(first: Column) -> Column:
        return (
            F.when(first.between("a", "z") | first.between("A", "Z") | (first == "_"), "word").when(first.isin(" ", "\t", "\n", "\x0b", "\f", "\r"), "space").when(first.between("0", "9"), "number")
            .when((first == "'") & (F.length(t) > 1), "text").when(first.isin('"', "`") & (F.length(t) > 1), "name").when((first == ":") & (F.length(t) > 1), "parameter")
            .when(F.left(t, F.lit(2)).isin("--", "/*"), "comment").otherwise("sign")
        )

    return _once(F.left(t, F.lit(1)), of)


def tokens(sql: Column) -> Column:
    """The tokens of a statement, as structs of text and kind; null for null."""
    return F.transform(F.regexp_extract_all(sql, F.lit(f"({TOKEN})"), 1), lambda t: _named(text=t, kind=_kind(t)))


def text_of(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["text"]), "")


def solid(tokens: Column) -> Column:
    """The tokens without white space and comments, each with ``low``, its text without quotes and, for words, in lower case."""
    def low(t: Column) -> Column:
        return F.when(t["kind"] == "word", F.lower(t["text"])).when(t["kind"] == "name", F.substring(t["text"], F.lit(2), F.length(t["text"]) - 2)).otherwise(t["text"])

    return F.transform(F.filter(tokens, lambda t: ~t["kind"].isin("space", "comment")), lambda t: _named(text=t["text"], kind=t["kind"], low=low(t)))


def with_depth(solid: Column) -> Column:
    """Adds ``depth``, the number of brackets that are open around a token (the brackets themselves stand outside)."""
    start = _named(depth=F.lit(0), all=F.array().cast("array<int>"))

    def step(state: Column, t: Column) -> Column:
        own = F.when(t["text"] == ")", state["depth"] - 1).otherwise(state["depth"])
        return _named(depth=F.when(t["text"] == "(", own + 1).otherwise(own), all=F.array_append(state["all"], own))

    def both(solid: Column) -> Column:
        depths = F.aggregate(solid, start, step, lambda s: s["all"])
        return F.zip_with(solid, depths, lambda t, d: _named(text=t["text"], kind=t["kind"], low=t["low"], depth=d))

    return _once(solid, both)


def tables(solid: Column) -> Column:
    """Names behind FROM, then those behind JOIN, each once."""
    def behind(solid: Column, word: str) -> Column:
        at = F.transform(solid, lambda t, i: F.when((t["kind"] == "word") & (t["low"] == word), F.get(solid, i + 1)))
        named = F.filter(at, lambda t: t["kind"].isin("word", "name") & (F.lower(t["text"]) != "select"))
        return F.transform(named, lambda t: F.when(t["kind"] == "word", t["text"]).otherwise(t["low"]))

    return _once(solid, lambda s: F.array_distinct(F.concat(behind(s, "from"), behind(s, "join"))))


def table_names(sql: Column) -> Column:
    """The same of a statement's text: only what stands behind FROM and JOIN is looked at closely, and no other token is given its kind. Null for null."""
    def behind(texts: Column, low: Column, word: str) -> Column:
        after = F.transform(F.filter(F.transform(low, lambda t, i: F.when(t == word, i + 1)), lambda i: i.isNotNull()), lambda i: F.get(texts, i))
        named = F.filter(after, lambda t: F.coalesce(_kind(t).isin("word", "name") & (F.lower(t) != "select"), F.lit(False)))
        return F.transform(named, lambda t: F.when(F.left(t, F.lit(1)).isin('"', "`"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))

    def of(texts: Column) -> Column:
        return _once(F.transform(texts, lambda t: F.lower(t)), lambda low: F.array_distinct(F.concat(behind(texts, low, "from"), behind(texts, low, "join"))))

    texts = F.regexp_extract_all(sql, F.lit(f"({TOKEN})"), 1)
    return _once(F.filter(texts, lambda t: ~F.regexp_like(t, F.lit(r"\A(?:\s|--|/\*)"))), of)


def _place(deep: Column, words: list[str], after: Column) -> Column:
    """Where the first of some words stands outside of brackets behind a place, from 1; 0 without one."""
    hit = F.transform(deep, lambda t, i: (t["kind"] == "word") & t["low"].isin(words) & (t["depth"] == 0) & (i + 1 > after))
    return F.coalesce(F.array_position(hit, F.lit(True)), F.lit(0)).cast("int")


def select_items(deep: Column) -> Column:
    """The items between SELECT (DISTINCT) and FROM, cut at commas outside of brackets, as texts of their tokens joined by blanks."""
    def cut(deep: Column, begin: Column, end: Column) -> Column:
        part = F.when((begin > 0) & (end > begin), F.slice(deep, begin + 1, end - begin - 1)).otherwise(F.array().cast("array<struct<text:string,kind:string,low:string,depth:int>>"))
        marked = F.array_join(F.transform(part, lambda t: F.when((t["text"] == ",") & (t["depth"] == 0), F.lit("\x00")).otherwise(t["text"])), " ")
        return F.filter(F.transform(F.split(marked, "\x00"), lambda x: F.trim(x)), lambda x: x != "")

    def from_begin(deep: Column, begin: Column) -> Column:
        return _once(_place(deep, ["from"], begin), lambda end: cut(deep, begin, end))

    def from_select(deep: Column, select: Column) -> Column:
        return _once(select + F.when(F.get(deep, select)["low"] == "distinct", 1).otherwise(0), lambda begin: from_begin(deep, begin))

    return _once(deep, lambda deep: _once(_place(deep, ["select"], F.lit(0)), lambda select: from_select(deep, select)))


def select_column(deep: Column) -> Column:
    """The column of a statement with one item that is a bare column, qualified or renamed at most; else null."""
    def one(items: Column) -> Column:
        plain = F.regexp_replace(F.get(items, F.lit(0)), r"(?i) as [A-Za-z_][A-Za-z0-9_]*\z", "")
        name = F.regexp_extract(plain, r"\A(?:[A-Za-z_][A-Za-z0-9_]* \. )?([A-Za-z_][A-Za-z0-9_]*)\z", 1)
        return F.when(F.size(items) == 1, F.when(name != "", name))

    return _once(select_items(deep), one)


def parameter_columns(solid: Column) -> Column:
    """(parameter, column) for each parameter that a column is held against by =, LIKE or IN, whatever wraps either side."""
    def held(bare: Column) -> Column:
        at = F.transform(bare, lambda t, i: F.when(t["kind"] == "parameter", _named(parameter=F.substring(t["text"], F.lit(2), F.length(t["text"])), column=F.when(F.get(bare, i - 1)["low"].isin(COMPARES) & F.get(bare, i - 2)["kind"].isin("word", "name"), F.get(bare, i - 2)["text"]))))
        return F.array_distinct(F.filter(at, lambda x: x["column"].isNotNull()))

    return _once(F.filter(solid, lambda t: ~t["text"].isin("(", ")", "'%'", "||", "'%%'") & ~((t["kind"] == "word") & t["low"].isin(WRAPS))), held)


def where_columns(deep: Column, columns: Column) -> Column:
    """Which of the ``columns`` the condition names, in its order and each once."""
    def cut(deep: Column, begin: Column, end: Column) -> Column:
        part = F.slice(deep, begin + 1, F.when(end > begin, end - begin - 1).otherwise(F.size(deep) - begin))
        named = F.transform(F.filter(part, lambda t: t["kind"].isin("word", "name")), lambda t: F.when(t["kind"] == "word", t["text"]).otherwise(t["low"]))
        return F.when(begin > 0, F.array_distinct(F.filter(named, lambda x: F.array_contains(columns, x)))).otherwise(F.array().cast("array<string>"))

    return _once(deep, lambda deep: _once(_place(deep, ["where"], F.lit(0)), lambda begin: _once(_place(deep, ENDS, begin), lambda end: cut(deep, begin, end))))


def literal(value: Column, number: Column) -> Column:
    """A value as SQL writes it."""
    return F.when(number, value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))


def rebound(tokens: Column, bindings: Column, least: int = 3) -> Column:
    """The statement with literals turned into parameters.

    ``bindings`` are structs (parameter, name, value, number). A quoted text of ``least`` characters or more that equals a
    value becomes :parameter, one that has it between % signs becomes '%' || :parameter || '%', and one with the day of a
    time between % signs takes the first ten characters of the parameter. A number becomes :parameter where it is held
    equal to a column called name, with white space at most between them. The first binding that fits is taken.
    """
    def before(i: Column) -> Column:
        """The place of the token before one, white space left out."""
        return i - 1 - F.when(F.get(tokens, i - 1)["kind"] == "space", 1).otherwise(0)

    def one(t: Column, i: Column) -> Column:
        inner = F.substring(t["text"], F.lit(2), F.length(t["text"]) - 2)
        core = F.regexp_extract(inner, r"(?s)\A%+(.*?)%+\z", 1)
        texts = F.filter(bindings, lambda b: F.length(b["value"]) >= least)
        same = F.get(F.filter(texts, lambda b: (b["value"] == inner) | ((core != "") & (b["value"] == core))), F.lit(0))
        day = F.get(F.filter(texts, lambda b: (F.length(core) == 10) & F.contains(b["value"], F.lit("T")) & F.startswith(b["value"], core)), F.lit(0))
        name = F.when(F.get(tokens, before(i))["text"] == "=", F.get(tokens, before(before(i)))["text"])
        number = F.get(F.filter(bindings, lambda b: b["number"] & (b["value"] == t["text"]) & (b["name"] == name)), F.lit(0))
        colon = lambda b: F.concat(F.lit(":"), b["parameter"])
        return (
            F.when((t["kind"] == "text") & same.isNotNull(), F.when(same["value"] == inner, colon(same)).otherwise(F.concat(F.lit("'%' || "), colon(same), F.lit(" || '%'"))))
            .when((t["kind"] == "text") & day.isNotNull(), F.concat(F.lit("'%' || substr("), colon(day), F.lit(", 1, 10) || '%'")))
            .when((t["kind"] == "number") & number.isNotNull(), colon(number)).otherwise(t["text"])
        )

    return F.array_join(F.transform(tokens, one), "")


def frozen(tokens: Column, bindings: Column, keep: Column | None = None) -> Column:
    """The statement with parameters turned into literals; those without a value, and those in ``keep``, stay."""
    def one(t: Column) -> Column:
        name = F.substring(t["text"], F.lit(2), F.length(t["text"]))
        b = F.get(F.filter(bindings, lambda b: (b["parameter"] == name) & b["value"].isNotNull()), F.lit(0))
        free = b.isNotNull() & (F.lit(True) if keep is None else ~F.array_contains(keep, name))
        return F.when((t["kind"] == "parameter") & free, literal(b["value"], b["number"])).otherwise(t["text"])

    return F.array_join(F.transform(tokens, one), "")


def unresolved(tokens: Column, bindings: Column) -> Column:
    """The parameters without a value, sorted."""
    names = F.transform(F.filter(tokens, lambda t: t["kind"] == "parameter"), lambda t: F.substring(t["text"], F.lit(2), F.length(t["text"])))
    known = F.transform(F.filter(bindings, lambda b: b["value"].isNotNull()), lambda b: b["parameter"])
    return F.array_sort(F.array_except(names, known))


def observed_facts(records: DataFrame, ident: str, app: str, sql: str, rows: str) -> DataFrame:
    """id, table (with its application), column, entity, value and place of each cell that a statement returned.

    ``rows`` is JSON: a list of objects, or an object with a list ``sample`` where the rows were cut. The table is the first one
    that the statement names; the entity is the table with the whole number of ``id``, else of ``rowid``, else with a star. Nulls,
    statements without a table or an application, and rows that are no objects give no facts.
    """
    listed = F.coalesce(F.from_json(F.col("_rows"), "array<variant>"), F.from_json(F.col("_rows"), "struct<sample:array<variant>>")["sample"])
    listed = F.transform(listed, lambda v: F.try_variant_get(v, "$", "map<string,variant>"))
    # the statement is read below the rows that it returned; a filter on its table would read it again
    own = records.select(F.col(ident).alias("id"), F.col(app).alias("_app"), F.get(tables(solid(tokens(F.col(sql)))), F.lit(0)).alias("_table"), F.col(rows).alias("_rows"))
    each = own.select("id", "_app", "_table", F.posexplode(F.when((F.col("_app") != "") & F.col("_table").isNotNull(), listed)).alias("_row", "_cells"))
    whole = lambda c: F.when(F.schema_of_variant(F.col("_cells")[c]).isin("BIGINT", "INT"), F.col("_cells")[c].cast("string"))
    number = F.when(F.map_contains_key("_cells", "id"), whole("id")).otherwise(whole("rowid"))
    cells = each.select("id", "_app", "_table", "_row", F.concat_ws(":", "_table", F.coalesce(number, F.lit("*"))).alias("entity"), F.posexplode(F.map_entries("_cells")).alias("_cell", "e"))
    value = F.col("e.value").cast("string")
    return cells.where(value.isNotNull()).select("id", F.concat_ws(".", "_app", "_table").alias("table"), F.col("e.key").alias("column"), "entity", value.alias("value"), F.struct(F.col("_row").alias("row"), F.col("_cell").alias("cell")).alias("place"))


def rendered_fields(records: DataFrame, facts: DataFrame, ident: str, app: str, route: str, source: str) -> DataFrame:
    """app, route, table, column, entity and value of the fields of each page: of equal fields the first one, by record and place.

    Records of the command line, and those without a route, belong to no page.
    """
    pages = records.where((F.coalesce(F.col(source), F.lit("")) != "cli") & (F.col(route) != "")).select(F.col(ident).alias("id"), F.col(app).alias("app"), F.col(route).alias("route"))
    own = facts.join(pages, "id").select("app", "route", F.expr("substr(table, length(app) + 2)").alias("table"), "column", "entity", F.struct("id", "place", "value").alias("f"))
    return own.groupBy("app", "route", "table", "column", "entity").agg(F.min("f").alias("f")).select("app", "route", "table", "column", "entity", "f.value")
