"""From nested documents to flat, ordered event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.functions import is_digits, iso_date, null_if_empty
from foreledger.functions import variants as V
from foreledger.operators import validate as VA

# Shape of the parsed part of a document.  Markers stay text, and what the
# structure check leaves untyped stays a variant until its content is checked.
DOC_SCHEMA = """
meta struct<data_version: string>,
info struct<balls_per_over: bigint, dates: array<string>, event: variant, gender: string,
  match_type: string, overs: bigint, teams: array<string>, venue: string,
  outcome: struct<winner: string, result: string, method: string, eliminator: string, bowl_out: string>,
  registry: struct<people: map<string, string>>, toss: struct<uncontested: variant>>,
innings array<struct<team: string, super_over: variant,
  target: struct<runs: bigint, overs: string>, penalty_runs: variant,
  powerplays: array<struct<from: string, to: string, type: string>>,
  miscounted_overs: map<string, struct<balls: string>>, absent_hurt: variant,
  overs: array<struct<over: bigint, deliveries: array<struct<
    batter: string, bowler: string, non_striker: string,
    runs: struct<batter: bigint, extras: bigint, total: bigint>,
    extras: struct<wides: bigint, noballs: bigint, byes: bigint, legbyes: bigint, penalty: bigint>,
    wickets: array<struct<player_out: string, kind: string, fielders: array<struct<name: string>>>>>>>>>>
"""


def over_part(marker: Column) -> Column:
    return F.split(marker, r"\.")[0].cast("int")


def ball_part(marker: Column) -> Column:
    """Ball number of an over.ball marker; 0 when there is none."""
    part = F.get(F.split(marker, r"\."), F.lit(1))
    return F.when(is_digits(part), part.cast("int")).otherwise(0)


def ball_ref(marker: Column) -> Column:
    return F.named_struct(F.lit("over"), over_part(marker), F.lit("ball"), ball_part(marker))


def overs_to_balls(marker: Column, balls_per_over: Column) -> Column:
    """17.2 overs of 6 -> 104; null when the ball part does not fit an over."""
    part = ball_part(marker)
    return F.when(part < balls_per_over, over_part(marker) * balls_per_over + part)


def checked_documents(docs: DataFrame) -> DataFrame:
    """(match_id, raw, error, doc): one row per document, no shuffle.

    ``doc`` is parsed only where the structure is sound; ``error`` is the first
    structural or content failure.
    """
    s = computed_once(docs, "__s", VA.structure_errors(F.col("raw")))
    s = computed_once(s, "doc", F.when(F.col("__s").isNull(), F.from_json("raw", DOC_SCHEMA)))
    content = F.when(F.col("doc").isNotNull(), VA.content_errors(F.col("doc")))
    s = computed_once(s, "error", F.coalesce("__s", content)).drop("__s")
    return computed_once(s.withColumnRenamed("doc", "__d"), "doc", F.when(
        F.col("error").isNull(), settled(F.col("__d")))).select("match_id", "raw", "error", "doc")


def settled(doc: Column) -> Column:
    """A document of sound content with its variants made plain columns."""
    def innings(n: Column) -> Column:
        pen = V.as_object(n["penalty_runs"])
        part = lambda k: F.coalesce(V.whole(V.member(pen, k)), F.lit(0)).cast("int").alias(k)
        return (n.withField("super_over", V.truthy(n["super_over"])).withField("penalty_runs", F.struct(part("pre"), part("post")))
                .withField("absent_hurt", V.names(n["absent_hurt"])))

    info = doc["info"]
    named = F.struct(V.text(V.member(V.as_object(info["event"]), "name")).alias("name"))
    info = info.withField("event", named).withField("toss", F.struct(
        V.truthy(info["toss"]["uncontested"]).alias("uncontested")))
    for k in ("balls_per_over", "overs"):
        info = info.withField(k, info[k].cast("int"))
    return doc.withField("info", info).withField("innings", F.transform(doc["innings"], innings))


def balls_of(stated: Column) -> Column:
    """Balls of a miscounted over; a truth value counts as 1 or 0."""
    return F.when(stated == "true", 1).when(stated == "false", 0).otherwise(stated.try_cast("int"))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append a costly column behind a generator.

    The optimizer copies a plain projection into every filter and expression
    that reads it; it does not copy a generator, so the value is worked out
    once per row.
    """
    return df.select("*", F.explode(F.array(F.struct(value.alias("v")))).alias("__g")).select(
        *df.columns, F.col("__g.v").alias(name))


def revised_target(info: Column) -> Column:
    return F.coalesce(info["outcome"]["method"].contains("D/L"), F.lit(False))


def headers(parsed: DataFrame) -> DataFrame:
    """Match-level columns of parsed documents."""
    i, o = "doc.info", "doc.info.outcome"
    no_result = F.coalesce(F.col(f"{o}.result") == "no result", F.lit(False))
    return parsed.select(
        "match_id", F.when(F.col(f"{i}.match_type") == "T20", "t20").otherwise("odi").alias("fmt"),
        F.col(f"{i}.gender").alias("gender"),
        F.coalesce(f"{i}.venue", F.lit("unknown")).alias("venue_id"),
        iso_date(F.col(f"{i}.dates")[0]).alias("start_date"),
        F.col(f"{i}.event.name").alias("competition"),
        F.col(f"{i}.teams")[0].alias("team1"), F.col(f"{i}.teams")[1].alias("team2"),
        F.col(f"{i}.balls_per_over").alias("balls_per_over"), F.col(f"{i}.overs").alias("scheduled_overs"),
        F.col(f"{o}.result").alias("outcome_result"), F.col(f"{o}.winner").alias("outcome_winner"),
        F.col(f"{o}.method").alias("outcome_method"), F.col(f"{o}.eliminator").alias("outcome_eliminator"),
        F.col(f"{o}.bowl_out").alias("outcome_bowl_out"),
        revised_target(F.col(i)).alias("dls_applied"),
        no_result.alias("no_result"),
        F.coalesce(f"{i}.toss.uncontested", F.lit(False)).alias("toss_uncontested"),
        F.coalesce(F.exists("doc.innings", lambda n: n["super_over"]), F.lit(False)).alias("has_super_over"),
        F.size("doc.innings").alias("n_innings"))


def flatten(parsed: DataFrame) -> DataFrame:
    """One row per delivery with its ordinal keys, ids resolved through the registry.

    ``innings_idx`` and ``ball_in_over`` count from 1; ``over_number`` is as
    given and ``over_pos`` is the over's place in its innings.
    """
    inn = parsed.select(
        "match_id", F.col("doc.info").alias("info"), F.posexplode("doc.innings").alias("ii", "inn"))
    bpo = F.col("info.balls_per_over")
    allowed = F.transform(F.map_values("inn.miscounted_overs"), lambda s: balls_of(s["balls"]))
    extra = F.coalesce(F.aggregate(
        allowed, F.lit(0), lambda s, b: s + F.greatest(F.lit(0), b - bpo)), F.lit(0))
    teams = F.col("info.teams")
    ranges = F.transform("inn.powerplays", lambda p: F.named_struct(
        F.lit("from"), ball_ref(p["from"]), F.lit("to"), ball_ref(p["to"])))
    side = inn.select(
        "match_id", (F.col("ii") + 1).cast("int").alias("innings_idx"),
        F.col("info.registry.people").alias("people"), bpo.alias("balls_per_over"),
        revised_target(F.col("info")).alias("dls_applied"),
        F.col("inn.team").alias("batting_team"),
        F.when(F.col("inn.team") == teams[0], teams[1]).otherwise(teams[0]).alias("bowling_team"),
        F.col("inn.target.runs").cast("int").alias("target"),
        (F.coalesce(overs_to_balls(F.col("inn.target.overs"), bpo), F.col("info.overs") * bpo)
         + extra).alias("max_balls"),
        F.coalesce("inn.penalty_runs.pre", F.lit(0)).alias("penalty_pre"),
        ranges.alias("powerplays"),
        F.posexplode("inn.overs").alias("over_pos", "ov"))
    ball = side.select(
        *[c for c in side.columns if c != "ov"], F.col("ov.over").cast("int").alias("over_number"),
        F.posexplode("ov.deliveries").alias("bi", "d"))
    rid = lambda c: F.try_element_at(F.col("people"), F.col(c))
    zero = lambda c: F.coalesce(c, F.lit(0))
    none = F.array().cast("array<struct<player_out: string, kind: string>>")
    outs = F.coalesce(F.transform("d.wickets", lambda w: F.named_struct(
        F.lit("player_out"), F.try_element_at(F.col("people"), w["player_out"]),
        F.lit("kind"), w["kind"])), none)
    return ball.select(
        *[c for c in ball.columns if c not in ("people", "bi", "d")],
        (F.col("bi") + 1).cast("int").alias("ball_in_over"),
        rid("d.batter").alias("batter_id"), rid("d.non_striker").alias("event_non_striker_id"),
        rid("d.bowler").alias("event_bowler_id"),
        *[F.col(f"d.runs.{k}").cast("int").alias(f"outcome_runs_{k}") for k in VA.RUNS_REQUIRED],
        *[zero(F.col(f"d.extras.{k}")).cast("int").alias(f"outcome_{k}") for k in VA.EXTRAS_KEYS],
        outs.alias("outs"))


def wicket_columns() -> dict[str, Column]:
    """Dismissal count and the two ``;``-joined texts of the ``outs`` column."""
    fell = F.filter("outs", lambda w: ~w["kind"].isin(*VA.NON_DISMISSALS))
    return {
        "outcome_n_wickets": F.size(fell),
        "outcome_wicket_kinds": null_if_empty(F.array_join(F.transform("outs", lambda w: w["kind"]), ";")),
        "outcome_players_out": null_if_empty(
            F.array_join(F.transform("outs", lambda w: w["player_out"]), ";")),
    }
