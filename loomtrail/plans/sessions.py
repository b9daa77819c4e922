"""Queries over the steps of sessions: typed actions and the pointer."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.operators import actions
from loomtrail.plans.tables import EV, indexed_events

#: The call of an event, by its id, as Spark and DuckDB both build it; ~ stands for a quote.
CALL = """translate(CASE event_id % 9 WHEN 0 THEN concat('pyautogui.click(', event_id * 37 % 2500 - 200, ', ', event_id * 53 % 1300 - 90, ')') WHEN 1 THEN 'pyautogui.click()' WHEN 2 THEN concat('pyautogui.scroll(', event_id % 7 - 3, ')')
  WHEN 3 THEN concat('pyautogui.dragTo(x=', event_id * 11 % 2000, ', y=', event_id * 7 % 1100, ', button=~left~)') WHEN 4 THEN concat('pyautogui.write(~', event_type, '; ', event_id, '~)') WHEN 5 THEN 'pyautogui.moveTo(5, 6, duration=2)'
  WHEN 6 THEN concat('import pyautogui; pyautogui.press(~tab~); pyautogui.moveTo(', event_id % 1920, ', ', event_id % 1080, ')') WHEN 7 THEN 'WAIT' ELSE 'pyautogui.hotkey(~ctrl~, ~c~)' END, '~', chr(39))"""


def typed_actions(spark, d):
    """Actions of all events; the run of each user is a session."""
    e = indexed_events(spark, d).select("user_id", "idx", F.expr(CALL).alias("source"))
    out = actions.typed_actions(e, "user_id", "idx", "source", 1920, 1080, 2.0)
    return out.withColumn("keys", F.array_join("keys", "+")).drop("presses")


def pointer_faults(spark, d):
    """How many actions of each kind of fault each event type has."""
    e = indexed_events(spark, d)
    out = actions.typed_actions(e.select("user_id", "idx", F.expr(CALL).alias("source")), "user_id", "idx", "source", 1920, 1080, 2.0)
    return out.where("fault is not null").join(e.select("user_id", "idx", "event_type"), ["user_id", "idx"]).groupBy("event_type", "fault").agg(F.count("*").alias("n"))


def action_summaries(spark, d):
    e = indexed_events(spark, d).select("user_id", "idx", F.expr(CALL).alias("source"))
    return actions.typed_actions(e, "user_id", "idx", "source", 1920, 1080, 2.0).select("user_id", "idx", "part", actions.summary().alias("summary"))


QUERIES = {f.__name__: f for f in (typed_actions, pointer_faults, action_summaries)}

_ACTIONS = f"""{EV}, a AS (
    SELECT *, event_id % 9 AS m, 0 AS part FROM ev UNION ALL SELECT *, 9 AS m, 1 AS part FROM ev WHERE event_id % 9 = 6),
  b AS (SELECT *, CASE m WHEN 0 THEN least(greatest(event_id * 37 % 2500 - 200, 0), 1919) WHEN 9 THEN event_id % 1920 WHEN 3 THEN least(event_id * 11 % 2000, 1919) END AS px,
    CASE m WHEN 0 THEN least(greatest(event_id * 53 % 1300 - 90, 0), 1079) WHEN 9 THEN event_id % 1080 WHEN 3 THEN least(event_id * 7 % 1100, 1079) END AS py FROM a),
  c AS (SELECT *, coalesce(bool_or(m IN (0, 9)) OVER w, false) AS known FROM b WINDOW w AS (PARTITION BY user_id ORDER BY idx, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  p AS (SELECT *, last_value(CASE WHEN m IN (0, 9) OR m = 3 AND known THEN px END IGNORE NULLS) OVER w AS bx, last_value(CASE WHEN m IN (0, 9) OR m = 3 AND known THEN py END IGNORE NULLS) OVER w AS y0
    FROM c WINDOW w AS (PARTITION BY user_id ORDER BY idx, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT *, CASE WHEN m = 5 THEN 'takes time' WHEN NOT known AND (m IN (1, 3) OR m = 2 AND event_id % 7 <> 3) THEN 'no pointer' END AS fault FROM p)"""
ORACLE = {
    "action_summaries": f"""WITH {_ACTIONS}, t AS (SELECT *, CASE WHEN m IN (0, 3, 9) THEN px ELSE bx END AS x, CASE WHEN m IN (0, 3, 9) THEN py ELSE y0 END AS y FROM f)
      SELECT user_id, idx, part, CASE WHEN fault IS NULL THEN CASE m WHEN 0 THEN 'Click at (' || x || ', ' || y || ').' WHEN 1 THEN 'Click at (' || x || ', ' || y || ').'
        WHEN 2 THEN CASE event_id % 7 WHEN 3 THEN 'No desktop action.' ELSE 'Scroll ' || CASE WHEN event_id % 7 > 3 THEN 'up' ELSE 'down' END || ' by ' || abs(event_id % 7 - 3) || ' units at (' || x || ', ' || y || ').' END
        WHEN 3 THEN 'Drag from (' || bx || ', ' || y0 || ') to (' || x || ', ' || y || ').' WHEN 4 THEN 'Type ''' || event_type || '; ' || event_id || '''.' WHEN 6 THEN 'Press hotkey tab.' WHEN 7 THEN 'Wait for 2.00 seconds.'
        WHEN 8 THEN 'Press hotkey ctrl+c.' ELSE 'Move the pointer to (' || x || ', ' || y || ').' END END AS summary FROM t""",
    "typed_actions": f"""WITH {_ACTIONS} SELECT user_id, idx, part,
      CASE WHEN fault IS NULL THEN CASE m WHEN 0 THEN 'click' WHEN 1 THEN 'click' WHEN 2 THEN CASE WHEN event_id % 7 = 3 THEN 'no_op' ELSE 'scroll' END WHEN 3 THEN 'drag' WHEN 4 THEN 'type' WHEN 7 THEN 'wait' WHEN 9 THEN 'move' ELSE 'hotkey' END END AS kind,
      CASE WHEN fault IS NULL THEN CASE WHEN m IN (0, 3, 9) THEN px WHEN m = 1 OR m = 2 AND event_id % 7 <> 3 THEN bx END END::INTEGER AS x, CASE WHEN fault IS NULL THEN CASE WHEN m IN (0, 3, 9) THEN py WHEN m = 1 OR m = 2 AND event_id % 7 <> 3 THEN y0 END END::INTEGER AS y,
      CASE WHEN fault IS NULL AND m = 3 THEN bx END::INTEGER AS from_x, CASE WHEN fault IS NULL AND m = 3 THEN y0 END::INTEGER AS from_y, CASE WHEN fault IS NULL AND m IN (0, 1, 3) THEN 'left' END AS button,
      CASE WHEN m = 4 THEN event_type || '; ' || event_id END AS text, CASE WHEN m = 6 THEN 'tab' WHEN m = 8 THEN 'ctrl+c' END AS keys, CASE WHEN fault IS NULL AND m = 2 THEN event_id % 7 - 3 END::INTEGER AS delta, CASE WHEN m = 7 THEN 2.0::DOUBLE END AS seconds, NULL::VARCHAR AS status, fault FROM f""",
    "pointer_faults": f"WITH {_ACTIONS} SELECT event_type, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1, 2",
}
