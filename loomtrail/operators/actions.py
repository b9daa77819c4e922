"""Steps of a run from calls in text, with the place of the pointer that each one needs.

A call is read by built-in functions. What it does to the pointer is a function of where the pointer was: it sets it,
leaves it, or (a drag) sets it if it was known. Such functions can be put together before they are applied, so the pointer
before each step comes from two levels: within blocks of steps, and over the blocks' results. No task holds more of a run
than a block of its steps, or one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a block.
BLOCK = 4096
_QUOTED = r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*\""""
_STATEMENT = rf"""((?:[^;\n'"]|{_QUOTED})+)"""
_ARGUMENT = rf"""((?:[^,'"\[\]]|{_QUOTED}|\[[^\]]*\])+)"""
#: Calls by what they take, in order (fixed values).
POSITIONAL = {
    "click": ["x", "y", "clicks", "interval", "button", "duration"], "doubleClick": ["x", "y", "interval", "button", "duration"], "tripleClick": ["x", "y", "interval", "button", "duration"], "rightClick": ["x", "y", "duration"],
    "moveTo": ["x", "y", "duration"], "dragTo": ["x", "y", "duration"], "scroll": ["clicks", "x", "y"], "hscroll": ["clicks", "x", "y"], "write": ["message", "interval"], "typewrite": ["message", "interval"],
    "press": ["keys", "presses", "interval"], "keyDown": ["key"], "keyUp": ["key"], "mouseDown": ["button"], "mouseUp": ["button"], "sleep": ["seconds"],
}
CLICKS = ["click", "doubleClick", "tripleClick", "rightClick"]
#: Whole sources with a meaning of their own (fixed values): kind and status.
WORDS = {"DONE": ("terminate", "success"), "FAIL": ("terminate", "failure"), "WAIT": ("wait", None), "NO_ACTIONS": ("no_op", None), "PREDICT_CRASH": ("terminate", "failure"), "PROTOCOL_ERROR": ("terminate", "failure"), "INFRASTRUCTURE_ERROR": ("terminate", "failure"), "TOOL_CALL": ("no_op", None)}


def statements(source: Column) -> Column:
    """The statements of a source, cut at line ends and semicolons outside of quotes; the import of the library is none."""
    each = F.transform(F.regexp_extract_all(source, F.lit(_STATEMENT), 1), lambda s: F.trim(s))
    return F.filter(each, lambda s: (s != "") & (s != "import pyautogui"))


def _unquoted(value: Column) -> Column:
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.when(value.rlike("""\\A(['"]).*\\1\\z"""), F.regexp_replace(inner, r"\\(.)", "$1"))


def primitives(steps: DataFrame, run: str, order: str, source: str) -> DataFrame:
    """run, order, part, method and arguments (a map) of each statement of each step."""
    s = steps.select(F.col(run).alias("run"), F.col(order).alias("at"), F.posexplode_outer(statements(F.col(source))).alias("part", "statement")).withColumn("part", F.coalesce("part", F.lit(0)))
    method = F.coalesce(F.regexp_extract("statement", r"\A(?:pyautogui\.|time\.)?([A-Za-z_]+)\s*\(", 1), F.lit(""))
    inside = F.regexp_extract("statement", r"(?s)\A[A-Za-z_.]+\s*\((.*)\)\s*\z", 1)
    s = s.withColumns({"method": method, "listed": F.transform(F.regexp_extract_all(inside, F.lit(_ARGUMENT), 1), lambda a: F.trim(a))})
    names = F.coalesce(*(F.when(F.col("method") == m, F.array(*(F.lit(n) for n in names))) for m, names in POSITIONAL.items()))
    named = F.filter("listed", lambda a: a.rlike(r"\A[A-Za-z_]+\s*=[^=]"))
    plain = F.filter("listed", lambda a: (a != "") & ~a.rlike(r"\A[A-Za-z_]+\s*=[^=]"))
    s = s.withColumns({"names": names, "named": named, "plain": plain})
    pairs = F.concat(
        F.transform("plain", lambda a, i: F.struct(F.coalesce(F.get("names", i), F.concat(F.lit("_"), i.cast("string"))).alias("key"), a.alias("value"))),
        F.transform("named", lambda a: F.struct(F.trim(F.split_part(a, F.lit("="), F.lit(1))).alias("key"), F.trim(F.regexp_replace(a, r"\A[A-Za-z_]+\s*=\s*", "")).alias("value"))),
    )
    once = F.size(F.array_distinct(F.transform(pairs, lambda p: p["key"]))) == F.size(pairs)
    args = F.when(once, F.map_from_entries(F.when(once, pairs)))  # an argument that is given twice makes the call unreadable
    return s.select("run", "at", "part", "statement", "method", "plain", args.alias("args"))


def typed(calls: DataFrame, width: int, height: int, wait_seconds: float) -> DataFrame:
    """Each call as an action, before the pointer is known: kind, its values, fault, and what it does to the pointer.

    ``moves`` is set (to px, py), drag, or null. Points outside of the frame are moved to its edge.
    """
    get = lambda k: F.get(F.array(F.col("args")[k]), F.lit(0))
    m, word = F.col("method"), F.upper(F.trim("statement"))
    whole = lambda k: F.try_to_number(get(k), F.lit("S999999999")).cast("long")
    number = lambda k: get(k).try_cast("double")
    x, y = (F.greatest(F.least(whole(k), F.lit(top - 1)), F.lit(0)) for k, top in (("x", width), ("y", height)))
    placed = get("x").isNotNull() & get("y").isNotNull()
    pointing = m.isin(*CLICKS, "moveTo", "dragTo", "scroll", "hscroll")
    unread = pointing & ((get("x").isNotNull() & whole("x").isNull()) | (get("y").isNotNull() & whole("y").isNull()))
    clicks = F.when(m == "doubleClick", 2).when(m == "tripleClick", 3).otherwise(F.coalesce(whole("clicks"), F.lit(1)))
    clicking, scrolling = m.isin(CLICKS), m.isin("scroll", "hscroll")
    keys = F.when(m == "hotkey", F.transform("plain", _unquoted)).when(get("keys").startswith("["), F.transform(F.regexp_extract_all(get("keys"), F.lit(f"({_QUOTED})"), 1), _unquoted)).otherwise(F.array(_unquoted(get("keys"))))
    kind = (
        F.when(word.isin(list(WORDS)), F.element_at(F.create_map(*(F.lit(v) for k, (n, _) in WORDS.items() for v in (k, n))), word))
        .when(clicking, F.when(clicks == 2, "double_click").when(clicks == 3, "triple_click").otherwise("click")).when(m == "moveTo", "move").when(m == "dragTo", "drag")
        .when(scrolling & (whole("clicks") == 0) & get("x").isNull() & get("y").isNull(), "no_op").when(m == "scroll", "scroll").when(m == "hscroll", "horizontal_scroll")
        .when(m.isin("write", "typewrite"), "type").when(m.isin("press", "hotkey"), "hotkey").when(m == "keyDown", "key_down").when(m == "keyUp", "key_up").when(m == "mouseDown", "mouse_down").when(m == "mouseUp", "mouse_up").when(m == "sleep", "wait")
    )
    timed = (F.coalesce(number("interval"), F.lit(0.0)) != 0) & (clicking | (m == "press")) | (F.coalesce(number("duration"), F.lit(0.0)) != 0) & (clicking | (m == "moveTo"))
    fault = (
        F.when(F.col("statement").isNull() | kind.isNull(), "unknown call").when(m != "", F.when(F.col("args").isNull(), "arguments").when(unread, "not a number").when(timed, "takes time"))
    )
    fault = F.coalesce(
        fault, F.when(clicking & ~clicks.isin(1, 2, 3), "clicks"), F.when(m.isin("moveTo", "dragTo") & ~placed, "no place"), F.when(scrolling & whole("clicks").isNull(), "no clicks"),
        F.when(scrolling & (get("x").isNull() != get("y").isNull()), "no place"), F.when(m.isin("write", "typewrite") & _unquoted(get("message")).isNull(), "no text"),
        F.when((m == "press") & ((get("presses").isNotNull() & whole("presses").isNull()) | (whole("presses") < 1)), "presses"), F.when(m.isin("press", "hotkey") & ((F.size(keys) == 0) | F.exists(keys, lambda k: k.isNull())), "no keys"), F.when((m == "sleep") & (F.coalesce(number("seconds"), F.lit(-1.0)) < 0), "no seconds"),
    )
    fine = fault.isNull()
    moves = F.when(fine & placed & (clicking | scrolling | (m == "moveTo")), "set").when(fine & (m == "dragTo"), "drag")
    return calls.select(
        "run", "at", "part", fault.alias("fault"), kind.alias("kind"), moves.alias("moves"), F.when(moves.isNotNull(), x).cast("int").alias("px"), F.when(moves.isNotNull(), y).cast("int").alias("py"),
        (F.coalesce((clicking | scrolling | (m == "dragTo")) & (kind != "no_op") & ~(placed & (m != "dragTo")), F.lit(False))).alias("needs"),
        F.when(clicking | m.isin("mouseDown", "mouseUp", "dragTo"), F.when(m == "rightClick", "right").otherwise(F.coalesce(_unquoted(get("button")), F.lit("left")))).alias("button"),
        F.when(m.isin("write", "typewrite"), _unquoted(get("message"))).when(m.isin("keyDown", "keyUp"), _unquoted(get("key"))).alias("text"),
        F.when(m.isin("press", "hotkey"), F.transform(keys, lambda k: F.when((m == "press") & (k == " "), "space").otherwise(k))).alias("keys"), F.when(scrolling, whole("clicks")).cast("int").alias("delta"),
        F.when(m == "press", F.coalesce(whole("presses"), F.lit(1))).cast("int").alias("presses"),
        F.when(m == "sleep", number("seconds")).when(word == "WAIT", F.lit(wait_seconds)).alias("seconds"),
        F.when(word.isin(list(WORDS)), F.element_at(F.create_map(*(F.lit(v) for k, (_, n) in WORDS.items() for v in (k, n))), word)).alias("status"),
    )


def with_pointer(actions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``before``, where the pointer was before each action (null if not known), as a struct of px and py.

    Takes run, at (a whole number, falling nowhere within a run), part, moves, px, py. Blocks are ranges of ``at``; a run without breaks has ``block`` steps in each.
    """
    rows = actions.withColumn("_block", F.floor(F.col("at") / block))
    place = F.struct("px", "py")
    here = Window.partitionBy("run", "_block").orderBy("at", "part").rowsBetween(Window.unboundedPreceding, -1)
    sets, drags = F.col("moves") == "set", F.col("moves") == "drag"
    # within a block: was the pointer set before, and where does it stand if it was known, or not known, when the block began
    known = F.coalesce(F.max(sets).over(here), F.lit(False))
    rows = rows.withColumn("_set", known)
    if_known = F.last(F.when(sets | drags, place), ignorenulls=True).over(here)
    if_not = F.last(F.when(sets | (drags & F.col("_set")), place), ignorenulls=True).over(here)
    rows = rows.withColumns({"_k": if_known, "_u": if_not})
    order = F.struct("at", "part")
    whole = rows.groupBy("run", "_block").agg(F.max(F.coalesce(sets, F.lit(False))).alias("s"), F.max(F.when(sets | drags, F.struct(order.alias("o"), place.alias("p"))))["p"].alias("k"), F.max(F.when(sets | (drags & F.col("_set")), F.struct(order.alias("o"), place.alias("p"))))["p"].alias("u"))
    before = Window.partitionBy("run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.withColumn("_known", F.coalesce(F.max("s").over(before), F.lit(False)))
    carried = carried.select("run", "_block", "_known", F.last(F.when(F.col("_known"), F.col("k")).otherwise(F.col("u")), ignorenulls=True).over(before).alias("_carried"))
    both = rows.join(carried, ["run", "_block"])
    return both.withColumn("before", F.when(F.col("_known"), F.coalesce("_k", "_carried")).otherwise(F.col("_u"))).drop("_block", "_set", "_k", "_u", "_known", "_carried")


def typed_actions(steps: DataFrame, run: str, order: str, source: str, width: int, height: int, wait_seconds: float, block: int = BLOCK) -> DataFrame:
    """run, order, part, kind, x, y, from_x, from_y (of drags), button, text, keys, presses, delta, seconds, status and fault of each action.

    A third click and repeated presses are one action each (triple_click, presses). An action that needs the pointer where it is not known has the fault ``no pointer`` and does not move it; so do faulty ones.
    """
    a = with_pointer(typed(primitives(steps, run, order, source), width, height, wait_seconds), block)
    lost = F.col("fault").isNull() & F.col("needs") & F.col("before").isNull()
    fault = F.when(lost, "no pointer").otherwise(F.col("fault"))
    fine, points = fault.isNull(), F.col("needs") | F.col("moves").isNotNull()
    x, y = (F.when(fine & points, F.coalesce(own, F.col("before")[own])) for own in ("px", "py"))
    drag = fine & (F.col("kind") == "drag")
    own = lambda c: F.when(fine, F.col(c)).alias(c)
    return a.select(F.col("run").alias(run), F.col("at").alias(order), "part", own("kind"), x.alias("x"), y.alias("y"), F.when(drag, F.col("before.px")).alias("from_x"), F.when(drag, F.col("before.py")).alias("from_y"), own("button"), own("text"), own("keys"), own("presses"), own("delta"), own("seconds"), own("status"), fault.alias("fault"))



def _repr(text: Column) -> Column:
    """A text in quotes, as Python writes it, for texts of printable characters, line ends and tabs."""
    inner = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'")))


def summary() -> Column:
    """One sentence for a typed action (the columns of ``typed_actions``); null for a faulty one."""
    at = lambda x, y: F.format_string("(%d, %d)", x, y)
    here, amount = at(F.col("x"), F.col("y")), F.abs("delta").cast("string")
    way = lambda up, down: F.when(F.col("delta") > 0, up).otherwise(down)
    click = F.concat(F.when(F.col("kind") == "double_click", "Double-click").otherwise("Click"), F.lit(" at "), here)
    press = F.concat(F.lit("Press hotkey "), F.array_join("keys", "+"))
    many = F.concat(F.lit("Execute in sequence: "), F.array_join(F.flatten(F.array_repeat(F.transform("keys", lambda k: F.concat(F.lit("Press hotkey "), k)), F.coalesce("presses", F.lit(1)))), "; "))
    several = F.col("presses").isNotNull() & (F.size("keys") * F.col("presses") > 1)
    # fixed values: the wording
    text = (
        F.when(F.col("kind").isin("click", "double_click"), click).when(F.col("kind") == "triple_click", F.concat(F.lit("Execute in sequence: "), F.array_join(F.array_repeat(click, 3), "; ")))
        .when(F.col("kind") == "type", F.concat(F.lit("Type "), _repr(F.col("text")))).when((F.col("kind") == "hotkey") & several, many).when(F.col("kind") == "hotkey", press)
        .when(F.col("kind") == "key_down", F.concat(F.lit("Hold key "), "text")).when(F.col("kind") == "key_up", F.concat(F.lit("Release key "), "text"))
        .when(F.col("kind") == "mouse_down", F.concat(F.lit("Hold mouse button "), "button")).when(F.col("kind") == "mouse_up", F.concat(F.lit("Release mouse button "), "button"))
        .when(F.col("kind") == "scroll", F.concat(F.lit("Scroll "), way("up", "down"), F.lit(" by "), amount, F.lit(" units at "), here))
        .when(F.col("kind") == "horizontal_scroll", F.concat(F.lit("Scroll horizontally "), way("right", "left"), F.lit(" by "), amount, F.lit(" units at "), here))
        .when(F.col("kind") == "move", F.concat(F.lit("Move the pointer to "), here)).when(F.col("kind") == "drag", F.concat(F.lit("Drag from "), at(F.col("from_x"), F.col("from_y")), F.lit(" to "), here))
        .when(F.col("kind") == "wait", F.concat(F.lit("Wait for "), F.format_string("%.2f", "seconds"), F.lit(" seconds"))).when(F.col("kind") == "terminate", F.concat(F.lit("Terminate the task with status "), "status")).when(F.col("kind") == "no_op", F.lit("No desktop action"))
    )
    return F.concat(text, F.lit("."))
