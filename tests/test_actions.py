"""Typed actions against a loop over each run."""

from __future__ import annotations

import random

import pytest

from loomtrail.operators import actions

W, H = 100, 80


def calls(rng):
    x, y = rng.randint(-20, 120), rng.randint(-20, 100)
    return rng.choice([
        (f"pyautogui.click({x}, {y})", ("click", x, y)), (f"click(x={x}, y={y}, button='right')", ("click", x, y)), ("pyautogui.click()", ("click", None, None)), (f"pyautogui.doubleClick(y={y}, x={x})", ("double_click", x, y)),
        (f"pyautogui.moveTo({x}, {y})", ("move", x, y)), (f"pyautogui.moveTo({x}, {y}, duration=1)", None), (f"pyautogui.dragTo({x}, {y})", ("drag", x, y)), ("pyautogui.scroll(-3)", ("scroll", None, None)),
        (f"pyautogui.scroll(5, {x}, {y})", ("scroll", x, y)), ("pyautogui.scroll(0)", ("no_op", None, None)), (f"pyautogui.scroll(2, x={x})", None), ("pyautogui.hotkey('ctrl', 'c')", ("hotkey", None, None)),
        ("pyautogui.write('a; (b), c=1')", ("type", None, None)), ("pyautogui.sleep(1.5)", ("wait", None, None)), ("DONE", ("terminate", None, None)), ("nonsense(1)", None), ("", None), ("pyautogui.click('a', 'b')", None),
    ])


def walked(sources):
    at, out = None, []
    for step, parts in enumerate(sources):
        for part, (_, what) in enumerate(parts):
            if what is None:
                out.append((step, part, None, None, None, None))
                continue
            kind, x, y = what
            place = None if x is None else (min(max(x, 0), W - 1), min(max(y, 0), H - 1))
            needs = kind in ("click", "scroll") and place is None or kind == "drag"
            if needs and at is None:
                out.append((step, part, None, None, None, None))
                continue
            if kind in ("no_op", "hotkey", "type", "wait", "terminate"):
                out.append((step, part, kind, None, None, None))
                continue
            out.append((step, part, kind, *(place or at), at if kind == "drag" else None))
            at = place or at
    return out


@pytest.mark.parametrize("block", [4096, 7, 1])
def test_pointer(spark, block):
    rng, rows, want = random.Random(block), [], set()
    for run in range(12):
        sources = []
        for step in range(rng.randint(1, 60)):
            parts = [calls(rng) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
            if len(parts) > 1:
                parts = [p for p in parts if p[0]] or [("DONE", ("terminate", None, None))]
            sources.append(parts)
            rows.append((run, step, rng.choice(["; ", "\n"]).join(p[0] for p in parts)))
        want |= {(run, *x) for x in walked(sources)}
    df = spark.createDataFrame(rows, "run int, step int, source string").repartition(4)
    got = actions.typed_actions(df, "run", "step", "source", W, H, 2.0, block).collect()
    assert {(r.run, r.step, r.part, r.kind, r.x, r.y, None if r.from_x is None else (r.from_x, r.from_y)) for r in got} == want and len(got) == len(want)
    assert all((r.kind is None) == (r.fault is not None) for r in got)


def test_values(spark):
    rows = ["WAIT", "PREDICT_CRASH", "press('enter', presses=2)", "press([' ', \"tab\"])", "write(\"it's, \\\"x\\\"\")", "keyDown('shift')", "time.sleep(3)", "rightClick(1, 2)", "tripleClick(1, 2)", "hscroll(-4, 5, 6)", "click(1, 2, clicks=5)", "import pyautogui\npyautogui.hotkey('alt', 'f4')", None, "click(x=1, x=2, y=3)", "sleep(-1)", "write(5)"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(rows)], "run int, step int, source string")
    r = {x.step: x for x in actions.typed_actions(df, "run", "step", "source", W, H, 2.5).collect()}
    assert r[0].seconds == 2.5 and r[1].status == "failure" and r[2].keys == ["enter"] and r[3].keys == ["space", "tab"] and r[4].text == 'it\'s, "x"' and r[5].text == "shift" and r[6].seconds == 3.0
    assert r[7].button == "right" and r[8].kind == "triple_click" and (r[9].kind, r[9].delta, r[9].x, r[9].y) == ("horizontal_scroll", -4, 5, 6) and r[11].keys == ["alt", "f4"]
    assert {k: r[k].fault for k in (10, 12, 13, 14, 15)} == {10: "clicks", 12: "unknown call", 13: "arguments", 14: "no seconds", 15: "no text"}
    assert actions.typed_actions(df.limit(0), "run", "step", "source", W, H, 2.5).count() == 0
