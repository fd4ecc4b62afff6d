"""State before each event, by windows.

The state of a group (an innings, a user session) before an event is a set of
running values over earlier events plus a few columns that depend only on the
event just before.  Both are declared as window expressions over one
partitioning, so Spark plans one exchange for the whole fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreledger.operators.scan import by_size, cut, join_on, running
from foreledger.operators.validate import BOWLER_CREDITED, NON_DISMISSALS, position_error


def running_state(
    df: DataFrame, group: Sequence[str], order: Sequence[str], *,
    value: Column, legal: Column, falls: Column, flag: Column | None = None,
    chunk: Sequence[Column] = (),
    start: Column | None = None, post: bool = False,
) -> DataFrame:
    """Running score, legal count, falls, last fall, partnership, previous-event flag.

    Appends ``runs, legal_balls, wickets, fow_last_runs, fow_last_ball,
    partnership_runs, partnership_balls, last_flag`` as seen before each event,
    and the same with a ``post_`` prefix after it when ``post`` is set.
    ``falls`` is the number of dismissals on the event.  Safe for a hot group
    when ``chunk`` is given: the partnership is the score since the last fall,
    so every column is a running value and none needs the whole group.
    """
    zero = F.lit(0)
    start = zero if start is None else start
    base = df.withColumns({
        "__v": value, "__b": legal.cast("int"), "__f": F.coalesce(falls, zero).cast("int"),
        "__flag": F.lit(False) if flag is None else F.coalesce(flag, F.lit(False)),
        "__start": start,
    })
    src, names = cut(base, chunk)
    keys = [*group, *names]
    w = Window.partitionBy(*keys).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = src.withColumns({
        "__r": F.sum("__v").over(upto), "__l": F.sum("__b").over(upto),
        "__w": F.sum("__f").over(upto),
    })
    mark = F.when(F.col("__f") > 0, F.struct(F.col("__r").alias("r"), F.col("__l").alias("l")))
    local = local.withColumns({
        "__fall": F.last(mark, ignorenulls=True).over(past), "__mark": mark,
        "__pf": F.lag("__flag").over(w),
    })
    if names:
        at = F.struct(*order)
        total = local.groupBy(*keys).agg(
            F.sum("__v").alias("tr"), F.sum("__b").alias("tl"), F.sum("__f").alias("tw"),
            F.max_by("__mark", F.when(F.col("__mark").isNotNull(), at)).alias("tm"),
            F.max_by("__flag", at).alias("tf"),
        )
        cw = Window.partitionBy(*group).orderBy(*names)
        before = cw.rowsBetween(Window.unboundedPreceding, -1)
        carried = total.withColumns({
            f"c{c}": F.coalesce(F.sum(f"t{c}").over(before), zero) for c in "rlw"
        })
        shifted = F.when(F.col("tm").isNotNull(), F.struct(
            (F.col("tm.r") + F.col("cr")).alias("r"), (F.col("tm.l") + F.col("cl")).alias("l")))
        carry = carried.withColumn("__abs", shifted).select(
            *keys, "cr", "cl", "cw", F.lag("tf").over(cw).alias("cf"),
            F.last("__abs", ignorenulls=True).over(before).alias("cm"),
        )
        local = join_on(local, carry, keys, "left")
        fall = F.when(F.col("__fall").isNotNull(), F.struct(
            (F.col("__fall.r") + F.coalesce("cr", zero)).alias("r"),
            (F.col("__fall.l") + F.coalesce("cl", zero)).alias("l"))).otherwise(F.col("cm"))
        after = {k: F.col(f"__{k}") + F.coalesce(f"c{k}", zero) for k in "rlw"}
        prev_flag = F.coalesce("__pf", "cf", F.lit(False))
    else:
        fall = F.col("__fall")
        after = {k: F.col(f"__{k}") for k in "rlw"}
        prev_flag = F.coalesce("__pf", F.lit(False))
    runs0, legal0, wk0 = after["r"] - F.col("__v"), after["l"] - F.col("__b"), after["w"] - F.col("__f")
    fell = F.col("__f") > 0
    since_r = runs0 - F.coalesce(fall["r"], zero)
    since_l = legal0 - F.coalesce(fall["l"], zero)
    out = {
        "runs": runs0 + F.col("__start"), "legal_balls": legal0, "wickets": wk0,
        "fow_last_runs": fall["r"] + F.col("__start"), "fow_last_ball": fall["l"],
        "partnership_runs": since_r, "partnership_balls": since_l, "last_flag": prev_flag,
    }
    if post:
        out |= {
            "post_runs": after["r"] + F.col("__start"), "post_legal_balls": after["l"],
            "post_wickets": after["w"],
            "post_partnership_runs": F.when(fell, zero).otherwise(since_r + F.col("__v")),
            "post_partnership_balls": F.when(fell, zero).otherwise(since_l + F.col("__b")),
            "post_last_flag": F.col("__flag"),
        }
    return local.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def actor_ledger(
    df: DataFrame, group: Sequence[str], order: Sequence[str], actor: str, *,
    counters: dict[str, Column], chunk: Sequence[Column] = (),
) -> DataFrame:
    """Cumulative per-actor counters before each event, attributed as stored.

    ``state_<actor>`` is the actor the state holds before the event.  An actor
    who already appeared in the group gets their own totals back.  On an
    actor's first event the state still holds the previous event's actor, with
    their totals up to and including that event; on the first event of the
    group it holds the event's own actor with zeros.

    With ``chunk`` only groups too large for one task are cut by it; the others
    are dealt out once by group and scanned whole.
    """
    if chunk:
        whole, large = by_size(df, group)
        small = _ledger(whole, group, order, actor, counters)
        return small if large is None else small.unionByName(
            _ledger(large, group, order, actor, counters, chunk))
    return _ledger(df, group, order, actor, counters)


def _ledger(df: DataFrame, group: Sequence[str], order: Sequence[str], actor: str, counters: dict[str, Column],
            chunk: Sequence[Column] = ()) -> DataFrame:
    own = running(df, [*group, actor], order,
                  sums=counters | {"__seen": F.lit(1)}, chunk=chunk)
    names = list(counters)
    held = F.struct(F.col(actor).alias("who"), *[
        (F.col(n) + e).alias(n) for n, e in counters.items()
    ])
    prev = running(own, group, order, lasts={"__prev": held}, chunk=chunk)
    swap = (F.col("__seen") == 0) & F.col("__prev").isNotNull()
    pick = lambda old, new: F.when(swap, old).otherwise(new)
    return prev.select(
        *df.columns,
        pick(F.col("__prev.who"), F.col(actor)).alias(f"state_{actor}"),
        *[pick(F.col(f"__prev.{n}"), F.col(n)).alias(n) for n in names],
    )


def predicted_slots(
    df: DataFrame, group: Sequence[str], order: Sequence[str], *,
    first: Column, second: Column, out: Column, crossings: Column, turn_end: Column,
    chunk: Sequence[Column] = (),
) -> DataFrame:
    """Two-slot occupancy before each event, from the previous event alone.

    ``out`` is an array of departing names (null or empty for none): their slot
    is empty until the next event names someone.  Slots swap when ``crossings``
    is odd and again at ``turn_end``.  Appends ``slot_a`` and ``slot_b``.
    """
    outs = F.coalesce(out, F.array().cast("array<string>"))
    gone = lambda p: F.when(F.array_contains(outs, p), F.lit(None)).otherwise(p)
    swap = (crossings % 2 == 1) != turn_end
    a, b = gone(first.cast("string")), gone(second.cast("string"))
    after = F.struct(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"))
    r = running(df.withColumn("__after", after), group, order,
                lasts={"__slots": F.col("__after")}, chunk=chunk)
    return r.select(*df.columns, F.col("__slots.a").alias("slot_a"),
                    F.col("__slots.b").alias("slot_b"))


def in_ranges(point: Column, ranges: Column) -> Column:
    """Is a struct inside any inclusive [from, to] range of an array column?"""
    return F.coalesce(F.exists(ranges, lambda r: (r["from"] <= point) & (point <= r["to"])),
                      F.lit(False))


# ---- the whole innings fold ---------------------------------------------------

INNINGS = ["match_id", "innings_idx"]
BALL = ["over_pos", "ball_in_over"]


def _names(*cols: str) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in cols])))


def batter_ledgers(df: DataFrame) -> DataFrame:
    """Runs and legal balls of both named batters before each event.

    Every event is an appearance of two batters.  A batter's ledger is the sum
    over earlier appearances they survived, restarted when they walk in fresh.
    They walk in fresh unless an earlier ledger exists and the slot they take
    is the one predicted to be vacant.  All windows share the innings
    partitioning of the input, so nothing is shuffled again.
    """
    sides = F.array(
        F.struct(F.lit(0).alias("role"), F.col("batter_id").alias("who"),
                 F.col("slot_a").isNull().alias("vacant")),
        F.struct(F.lit(1).alias("role"), F.col("event_non_striker_id").alias("who"),
                 F.col("slot_b").isNull().alias("vacant")))
    app = df.withColumn("__row", F.struct(*df.columns)).select(
        *INNINGS, *BALL, "__row", F.explode(sides).alias("__s")).select("*", "__s.*").drop("__s")
    alive = ~F.exists("__row.outs", lambda w: w["player_out"] == F.col("who"))
    striking = (F.col("role") == 0) & alive
    app = app.withColumns({
        "r": F.when(striking, F.col("__row.outcome_runs_batter")).otherwise(0),
        "b": F.when(striking & F.col("__row.legal"), 1).otherwise(0),
        "stays": alive.cast("int"),
        "entered": ~F.coalesce(F.array_contains("__row.at_crease", F.col("who")), F.lit(False)),
    })
    own = Window.partitionBy(*INNINGS, "who").orderBy(*BALL, "role")
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    app = app.withColumn("known", F.coalesce(F.max("stays").over(past), F.lit(0)) == 1)
    app = app.withColumn("restored", F.col("entered") & F.col("known") & F.col("vacant"))
    fresh = (F.col("entered") & ~F.col("restored")).cast("int")
    app = app.withColumn("spell", F.sum(fresh).over(
        own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spell = Window.partitionBy(*INNINGS, "who", "spell").orderBy(*BALL, "role").rowsBetween(
        Window.unboundedPreceding, -1)
    app = app.withColumn("ledger", F.struct(
        F.coalesce(F.sum("r").over(spell), F.lit(0)).cast("int").alias("runs"),
        F.coalesce(F.sum("b").over(spell), F.lit(0)).cast("int").alias("balls"), "restored"))
    per = app.groupBy(*INNINGS, *BALL).agg(
        F.first("__row").alias("__row"),
        F.max(F.when(F.col("role") == 0, F.col("ledger"))).alias("led_a"),
        F.max(F.when(F.col("role") == 1, F.col("ledger"))).alias("led_b"))
    return per.select("__row.*", "led_a", "led_b")


# Deliveries that one task of the fold sorts, some ten times over: about half a GB of its memory.
TASK_BALLS = 50_000


def fold_tasks(n_balls: int, default: int) -> int | None:
    """Tasks for a fold of so many deliveries; None when the session's own number will do."""
    n = -(-n_balls // TASK_BALLS)
    return n if n > default else None


def innings_fold(events: DataFrame, tasks: int | None = None) -> DataFrame:
    """Pre-event state of every delivery, and the first broken rule on it.

    Input: rows of :func:`foreledger.operators.events.flatten` with the match
    columns ``dls_applied`` attached.  One exchange by (match, innings): an
    innings comes out of a single document row, so its size is bounded by it.
    ``tasks`` is the number of tasks where the session's would be too few.
    Appends the stored state columns and ``event_error`` (null when sound).
    """
    c = F.col
    placed = events.repartition(*INNINGS) if tasks is None else events.repartition(tasks, *INNINGS)
    src = placed.withColumns({
        "legal": (c("outcome_wides") == 0) & (c("outcome_noballs") == 0),
        "n_out": F.size(F.filter("outs", lambda w: ~w["kind"].isin(*NON_DISMISSALS))),
        "out_ids": F.transform("outs", lambda w: w["player_out"]),
    })
    st = running_state(
        src, INNINGS, BALL, value=c("outcome_runs_total"), legal=c("legal"), falls=c("n_out"),
        flag=c("outcome_noballs") > 0, start=c("penalty_pre"))
    st = st.withColumnRenamed("last_flag", "last_ball_was_noball")
    post_legal = c("legal_balls") + c("legal").cast("int")
    st = predicted_slots(
        st, INNINGS, BALL, first=c("batter_id"), second=c("event_non_striker_id"), out=c("out_ids"),
        crossings=c("outcome_runs_batter") + c("outcome_byes") + c("outcome_legbyes")
        + F.greatest(c("outcome_wides") - 1, F.lit(0)),
        turn_end=c("legal") & (post_legal % c("balls_per_over") == 0))
    st = st.withColumn("at_crease", _names("slot_a", "slot_b"))
    credited = F.size(F.filter("outs", lambda w: w["kind"].isin(*BOWLER_CREDITED)))
    st = actor_ledger(
        st, INNINGS, BALL, "event_bowler_id",
        counters={"bowler_legal_balls": c("legal").cast("int"),
                  "bowler_runs_conceded": c("outcome_runs_batter") + c("outcome_wides") + c("outcome_noballs"),
                  "bowler_wickets": credited}).withColumnRenamed("state_event_bowler_id", "bowler_id")
    st = batter_ledgers(st)
    st = st.withColumn("event_error", _event_error())

    def slot(slot_col: str, who: str, led: str) -> dict[str, Column]:
        held = F.when(c(slot_col).isNotNull(), c(slot_col)).when(c(f"{led}.restored"), c(who))
        of = lambda f: F.when(held == c("batter_id"), c(f"led_a.{f}")).when(
            held == c("event_non_striker_id"), c(f"led_b.{f}"))
        return {"id": held, "runs": of("runs"), "balls": of("balls")}

    a, b = slot("slot_a", "batter_id", "led_a"), slot("slot_b", "event_non_striker_id", "led_b")
    here = F.struct(c("over_number").alias("over"), c("ball_in_over").alias("ball"))
    return st.withColumns(
        {f"striker_{k}": e for k, e in a.items()} | {f"non_striker_{k}": e for k, e in b.items()}
        | {"in_powerplay": in_ranges(here, c("powerplays"))}
    ).drop("slot_a", "slot_b", "led_a", "led_b", "at_crease", "out_ids", "n_out", "powerplays")


def _event_error() -> Column:
    """Dead innings, then crowded crease, then a departure from off the crease."""
    c = F.col
    pair = F.array(c("batter_id"), c("event_non_striker_id"))
    seen = lambda n: F.array_contains("at_crease", c(n))
    new = (~seen("batter_id")).cast("int") + (~seen("event_non_striker_id")).cast("int")
    dead = (
        (c("wickets") >= 10) | (c("legal_balls") >= c("max_balls"))
        | F.coalesce((c("runs") >= c("target")) & ~c("dls_applied"), F.lit(False)))
    crowded = (new > 0) & (new > 2 - F.size("at_crease"))
    twin = (new > 0) & (c("batter_id") == c("event_non_striker_id"))
    outs = c("out_ids")
    absent = (F.size(F.array_except(outs, pair)) > 0) | (F.size(outs) > F.size(F.array_distinct(outs)))
    where = lambda t: F.concat(F.lit(t), F.concat_ws(
        "/", c("innings_idx").cast("string"), c("over_number").cast("string"), c("ball_in_over").cast("string")))
    at = [c("innings_idx"), c("over_pos"), c("ball_in_over")]
    return (
        F.when(dead, position_error(*at, F.lit(0), "E_DEAD_STATE", where("delivery after the innings ended at ")))
        .when(crowded, position_error(*at, F.lit(1), "E_BALL_ACCOUNTING", where("more batters than vacant slots at ")))
        .when(twin, position_error(*at, F.lit(1), "E_SCHEMA", where("batter is own partner at ")))
        .when(absent, position_error(*at, F.lit(2), "E_BALL_ACCOUNTING", where("wicket of a player off the crease at "))))
