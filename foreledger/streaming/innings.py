"""The whole innings transition on a stream: slots, ledgers, error codes, expiry.

One key is one innings.  Totals and the two slots are a value state; every batter and
every bowler has an entry of their own in a map state, so an event reads and writes the
entries of the players it names and no others.  What comes out for an event is the state
before it, as the batch fold stores it, or the first broken rule, after which the innings
is closed.  An innings that stays silent is forgotten by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foreledger.operators.fold import BALL, INNINGS
from foreledger.operators.validate import BOWLER_CREDITED, NON_DISMISSALS

TOTALS = ("runs long, legal long, wickets long, fow_runs long, fow_ball long, since_runs long, since_balls long, "
          "noball boolean, slot_a string, slot_b string, bowler string, last_over long, last_ball long, closed boolean")
BATTER = "runs long, balls long, known boolean"
BOWLER = "legal long, conceded long, wickets long"
OUTPUT = ("match_id string, innings_idx int, over_pos int, ball_in_over int, runs long, legal_balls long, wickets long, "
          "fow_last_runs long, fow_last_ball long, partnership_runs long, partnership_balls long, "
          "last_ball_was_noball boolean, striker_id string, striker_runs long, striker_balls long, non_striker_id string, "
          "non_striker_runs long, non_striker_balls long, bowler_id string, bowler_legal_balls long, "
          "bowler_runs_conceded long, bowler_wickets long, reason string, late boolean")
_COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]
DAY_MS = 86_400_000


class _Ledger:
    """Entries of a map state that one micro-batch touches, written back once."""

    def __init__(self, state, empty: tuple):
        self.state, self.empty, self.held = state, empty, {}

    def __getitem__(self, who: str) -> tuple:
        if who not in self.held:
            self.held[who] = tuple(self.state.getValue((who,))) if self.state.containsKey((who,)) else self.empty
        return self.held[who]

    def __setitem__(self, who: str, value: tuple) -> None:
        self.held[who] = value

    def has(self, who: str) -> bool:
        return who in self.held and self.held[who] is not self.empty or self[who] is not self.empty

    def save(self) -> None:
        for who, value in self.held.items():
            if value is not self.empty:
                self.state.updateValue((who,), value)


class InningsFold(StatefulProcessor):
    """Fold the deliveries of an innings in order of (over_pos, ball_in_over)."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.batters = handle.getMapState("batters", "who string", BATTER)
        self.bowlers = handle.getMapState("bowlers", "who string", BOWLER)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(BALL, kind="stable")  # an innings is bounded by its document
        if self.totals.exists():
            t = dict(zip(_TOTAL_NAMES, self.totals.get()))
        else:
            start = int(batch["penalty_pre"].iloc[0])
            t = dict.fromkeys(_TOTAL_NAMES, 0) | {
                "runs": start, "fow_runs": None, "fow_ball": None, "noball": False, "slot_a": None, "slot_b": None,
                "bowler": None, "last_over": -1, "last_ball": -1, "closed": False}
        batters, bowlers = _Ledger(self.batters, (0, 0, False)), _Ledger(self.bowlers, (0, 0, 0))
        out = []
        for e in batch.itertuples(index=False):
            at = (int(e.over_pos), int(e.ball_in_over))
            late = at <= (t["last_over"], t["last_ball"])
            if late or not t["closed"]:
                out.append((*key, *at, *(_fold(t, e, batters, bowlers) if not late else [None] * (len(_COLUMNS) - 5)), late))
            if not late:
                t["last_over"], t["last_ball"] = at
        self.totals.update(tuple(t[n] for n in _TOTAL_NAMES))
        batters.save()
        bowlers.save()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=_COLUMNS).astype(_KINDS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.clear()
        self.batters.clear()
        self.bowlers.clear()
        yield pd.DataFrame(columns=_COLUMNS).astype(_KINDS)

    def close(self) -> None:
        pass


_TOTAL_NAMES = [part.split()[0] for part in TOTALS.split(", ")]
_KINDS = {part.split()[0]: {"long": "Int64", "int": "Int32", "string": "object", "boolean": "boolean"}[part.split()[1]]
          for part in OUTPUT.split(", ")}


def _broken_rule(t: dict, e) -> str | None:
    """Dead innings, then crowded crease, then a departure from off the crease."""
    crease = {s for s in (t["slot_a"], t["slot_b"]) if s is not None}
    pair = (e.batter_id, e.event_non_striker_id)
    new = sum(p not in crease for p in pair)
    outs = [w["player_out"] for w in e.outs]
    chased = not pd.isna(e.target) and t["runs"] >= e.target and not e.dls_applied
    if t["wickets"] >= 10 or t["legal"] >= e.max_balls or chased:
        return "E_DEAD_STATE"
    if new > 2 - len(crease):
        return "E_BALL_ACCOUNTING"
    if new and pair[0] == pair[1]:
        return "E_SCHEMA"
    return "E_BALL_ACCOUNTING" if set(outs) - set(pair) or len(set(outs)) < len(outs) else None


def _fold(t: dict, e, batters: _Ledger, bowlers: _Ledger) -> list:
    """State before event ``e``; then moves ``t`` and the ledgers past it."""
    slots, pair = (t["slot_a"], t["slot_b"]), (e.batter_id, e.event_non_striker_id)
    restored = [False, False]
    for role, who in enumerate(pair):
        if who not in slots:
            runs, balls, known = batters[who]
            restored[role] = known and slots[role] is None
            if not restored[role]:
                batters[who] = (0, 0, known)
    held = [s if s is not None else (who if back else None) for s, who, back in zip(slots, pair, restored)]
    ledger = [(None, None) if h is None else batters[h][:2] for h in held]
    first_spell = not bowlers.has(e.event_bowler_id) and t["bowler"] is not None
    bowler = t["bowler"] if first_spell else e.event_bowler_id
    reason = _broken_rule(t, e)
    before = [
        t["runs"], t["legal"], t["wickets"], t["fow_runs"], t["fow_ball"], t["since_runs"], t["since_balls"], t["noball"],
        held[0], *ledger[0], held[1], *ledger[1], bowler, *bowlers[bowler], reason]
    if reason:
        t["closed"] = True
        return before
    legal = int(e.outcome_wides == 0 and e.outcome_noballs == 0)
    outs = [w["player_out"] for w in e.outs]
    for role, who in enumerate(pair):
        if who not in outs:
            runs, balls, _ = batters[who]
            batters[who] = (runs + int(e.outcome_runs_batter), balls + legal, True) if role == 0 else (runs, balls, True)
    own = bowlers[e.event_bowler_id]
    bowlers[e.event_bowler_id] = (
        own[0] + legal, own[1] + int(e.outcome_runs_batter + e.outcome_wides + e.outcome_noballs),
        own[2] + sum(w["kind"] in BOWLER_CREDITED for w in e.outs))
    falls = sum(w["kind"] not in NON_DISMISSALS for w in e.outs)
    t["runs"] += int(e.outcome_runs_total)
    t["legal"] += legal
    t["wickets"] += falls
    if falls:
        t |= {"fow_runs": t["runs"], "fow_ball": t["legal"], "since_runs": 0, "since_balls": 0}
    else:
        t["since_runs"] += int(e.outcome_runs_total)
        t["since_balls"] += legal
    crossings = int(e.outcome_runs_batter + e.outcome_byes + e.outcome_legbyes + max(e.outcome_wides - 1, 0))
    after = [None if who in outs else who for who in pair]
    if (crossings % 2 == 1) != bool(legal and t["legal"] % e.balls_per_over == 0):
        after.reverse()
    t |= {"slot_a": after[0], "slot_b": after[1], "bowler": e.event_bowler_id, "noball": bool(e.outcome_noballs > 0)}
    return before


def stream_innings(deliveries: DataFrame, idle_ms: int = 7 * DAY_MS) -> DataFrame:
    """Pre-event state of every delivery of a streaming (or batch) frame.

    ``deliveries`` has the columns of :func:`foreledger.operators.events.flatten`.  An
    event at or before the last one folded comes out with ``late`` set and no state.
    ``reason`` is set on the event that broke a rule; no later event of that innings
    comes out.  An innings silent for ``idle_ms`` is forgotten.
    """
    needed = [
        *INNINGS, *BALL, "penalty_pre", "batter_id", "event_non_striker_id", "event_bowler_id", "outs", "target", "dls_applied",
        "max_balls", "balls_per_over", "outcome_runs_batter", "outcome_runs_total", "outcome_wides", "outcome_noballs",
        "outcome_byes", "outcome_legbyes"]
    return deliveries.select(*needed).groupBy(*INNINGS).transformWithStateInPandas(
        InningsFold(idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")
