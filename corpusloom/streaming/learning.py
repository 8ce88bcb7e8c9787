"""Learning from a stream of interactions: reverts, deferred learning, ranking weights and streaks, one state per user.

Every operator here is a step (state, event) -> (state, rows). folded() runs it
over a table, streaming over sorted partitions with one user's state at a time;
followed() runs the same step over a stream, with the state kept by Spark. Events
of a user are taken in the order of seq; a state is a small JSON text.

Events are (user, seq, at, kind, source, target, kept, shown, accepted): a
correction of source to target; an undo that put source back in place of
target; an edit, with `kept` false where it took the word away that was last
put back; an accept, with what was shown (a feature array for each item) and
which item it was. An undo without a time is learned at the user's next event
unless that takes the word away; an accept without one counts for no day.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta

import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.correct import learn_weights

EVENT = "user string, seq long, at timestamp, kind string, source string, target string, kept boolean, shown array<array<double>>, accepted int"
REMEMBERED = 24  # fixed value: corrections that an undo is recognised by
IDLE = timedelta(milliseconds=1500)  # fixed value: after so long a word that was put back counts as kept
FIRST_WEIGHTS = (1.0, 1.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)  # log-probability and channel cost alone

Step = Callable[[dict, dict], tuple[dict, list[tuple]]]


def one_shot_reverts(events: DataFrame) -> DataFrame:
    """(user, seq, source, target) of undos right after a correction, which takes it back once."""
    order = Window.partitionBy("user").orderBy("seq")
    before = {c: F.lag(c).over(order) for c in ("kind", "source", "target")}
    return events.select("user", "seq", "kind", before["kind"].alias("last"), before["source"].alias("source"), before["target"].alias("target")).where("kind = 'undo' and last = 'correct'").select("user", "seq", "source", "target")


def deferred_step(state: dict, event: dict) -> tuple[dict, list[tuple]]:
    """Rows (action, word): a revert when an undo matches one of the last corrections, and what is learned of it.

    The word is learned at the next event, unless that took it away, or once
    IDLE has passed.
    """
    rows, recent, pending = [], list(state.get("recent", [])), state.get("pending")
    if pending is not None:
        waited = event["at"] is not None and pending[1] is not None and event["at"] - datetime.fromisoformat(pending[1]) >= IDLE
        if waited or event["kept"] is not False:
            rows.append(("learn", pending[0]))
        pending = None
    if event["kind"] == "correct":
        recent = [*recent, [event["source"], event["target"]]][-REMEMBERED:]
    elif event["kind"] == "undo" and [event["source"], event["target"]] in recent:
        recent.remove([event["source"], event["target"]])
        rows.append(("revert", event["source"]))
        pending = [event["source"], event["at"].isoformat() if event["at"] else None]
    return {"recent": recent, "pending": pending}, rows


def deferred_idle(state: dict) -> tuple[dict, list[tuple]]:
    """What the end of a pause, or of a table, learns."""
    pending = state.get("pending")
    return state | {"pending": None}, [("learn", pending[0])] if pending else []


def weights_step(state: dict, event: dict) -> tuple[dict, list[tuple]]:
    """Rows (action, weights): the ranking's weights after each accepted item, in order."""
    own = state.get("weights", list(FIRST_WEIGHTS))
    if event["kind"] == "accept" and event["shown"] is not None and event["accepted"] is not None:
        own = learn_weights(own, [list(x) for x in event["shown"]], int(event["accepted"]))
        return {"weights": own}, [("weights", json.dumps(own))]
    return {"weights": own}, []


def streak_step(state: dict, event: dict) -> tuple[dict, list[tuple]]:
    """Rows (action, days): the run of days with an accept, after each one."""
    if event["kind"] != "accept" or event["at"] is None:
        return state, []
    day, last = event["at"].date(), state.get("last")
    run = state.get("run", 0)
    if last != day.isoformat():
        run = run + 1 if last and date.fromisoformat(last) + timedelta(days=1) == day else 1
    return {"last": day.isoformat(), "run": run}, [("streak", str(run))]


OUT = "user string, seq long, action string, word string"
COLUMNS = ["user", "seq", "action", "word"]


def _events(pdf: pd.DataFrame) -> Iterator[dict]:
    for row in pdf.to_dict("records"):
        row["at"] = None if pd.isna(row["at"]) else row["at"].to_pydatetime()
        row["kept"] = None if row["kept"] is None or row["kept"] is pd.NA or row["kept"] != row["kept"] else bool(row["kept"])
        row["accepted"] = None if pd.isna(row["accepted"]) else int(row["accepted"])
        yield row


def folded(events: DataFrame, step: Step, idle: Callable[[dict], tuple[dict, list[tuple]]] | None = None) -> DataFrame:
    """(user, seq, action, word) of a step over a table; what is left at a user's end, by `idle`, has the last seq."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state, seq, begun = None, {}, None, False
        for pdf in batches:
            out = []
            for event in _events(pdf):
                if not begun or event["user"] != user:
                    if begun and idle:
                        out += [(user, seq, *r) for r in idle(state)[1]]
                    user, state, begun = event["user"], {}, True
                seq = event["seq"]
                state, rows = step(state, event)
                out += [(user, seq, *r) for r in rows]
            yield pd.DataFrame(out, columns=COLUMNS)
        if begun and idle:
            yield pd.DataFrame([(user, seq, *r) for r in idle(state)[1]], columns=COLUMNS)

    names = [x.split()[0] for x in EVENT.split(", ")]
    return events.select(*names).repartition("user").sortWithinPartitions("user", "seq").mapInPandas(run, OUT)


def followed(events: DataFrame, step: Step, idle: Callable[[dict], tuple[dict, list[tuple]]] | None = None) -> DataFrame:
    """The same over a stream; `idle` runs for users who have been silent for IDLE of processing time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, seq = (json.loads(held.get[0]), held.get[1]) if held.exists else ({}, None)
        out = []
        if held.hasTimedOut:
            state, rows = idle(state)
            out += [(key[0], seq, *r) for r in rows]
        for event in _events(pd.concat(list(batches), ignore_index=True).sort_values("seq") if not held.hasTimedOut else pd.DataFrame(columns=["at", "kept", "accepted"])):
            seq = event["seq"]
            state, rows = step(state, event)
            out += [(key[0], seq, *r) for r in rows]
        held.update((json.dumps(state), seq))
        if idle and not held.hasTimedOut:
            held.setTimeoutDuration(int(IDLE.total_seconds() * 1000))
        yield pd.DataFrame(out, columns=COLUMNS)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return events.groupBy("user").applyInPandasWithState(run, OUT, "state string, seq long", "append", timeout)
