"""Documents to tables: facts, matches, players, quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreledger import SCHEMA_VERSION
from foreledger.functions import iso_date
from foreledger.operators import census, digest, events, fold, splits, validate
from foreledger.operators.features import outcome_class
from foreledger.sources import sinks
from foreledger.sources.schemas import FACT_SCHEMA, MATCH_SCHEMA, PLAYER_SCHEMA
from foreledger.sources.stored import stored

# Order keys and content that identify one event in a stream fingerprint.
HASHED = [c for c in FACT_SCHEMA.names if c not in ("temporal_split",)]


@dataclass(frozen=True)
class Corpus:
    facts: DataFrame
    matches: DataFrame
    players: DataFrame
    quarantine: DataFrame
    warnings: DataFrame
    bounds: DataFrame


def scope_dates(docs: DataFrame) -> DataFrame:
    """(match_id, start_date) of every readable in-scope document, quarantined later or not."""
    kind = F.get_json_object("raw", "$.info.match_type")
    day = iso_date(F.get_json_object("raw", "$.info.dates[0]"))
    return docs.filter(kind.isin(*validate.IN_SCOPE)).select("match_id", day.alias("start_date")).filter(
        "start_date is not null")


def build(docs: DataFrame, materialize: bool = True, bounds: DataFrame | None = None) -> Corpus:
    """Plan the whole build; split bounds are those of ``docs`` unless given.

    Documents are checked and parsed where they are read; one exchange by
    (match, innings) serves the fold.  The folded events are written once to
    the checkpoint folder because the quarantine and all tables read them.
    """
    checked = events.checked_documents(docs)
    if materialize:
        checked = stored(checked.drop("raw"))
    if bounds is None:
        bounds = splits.temporal_bounds(scope_dates(docs), "start_date")
    sound = checked.filter("error is null")
    head = splits.assign_split(events.headers(sound), "start_date", bounds)
    # The revised-target flag rides with the flattened rows, so no join is needed.
    flat = events.flatten(sound)
    if materialize:
        folded = stored(fold.innings_fold(flat, _fold_tasks(sound)))
    else:
        folded = fold.innings_fold(flat)
    over = sound.select("match_id", validate.over_errors(F.col("doc")).alias("e")).filter("e is not null")
    ball = folded.filter("event_error is not null").select("match_id", F.col("event_error").alias("e"))
    replay = ball.unionByName(over).groupBy("match_id").agg(F.min("e").alias("e")).select(
        "match_id", "e.reason", "e.detail")
    quarantine = checked.filter("error is not null").select(
        "match_id", "error.reason", "error.detail").unionByName(replay)
    good = head.join(replay.select("match_id"), "match_id", "left_anti")
    rows = folded.drop("balls_per_over", "dls_applied").join(good, "match_id")
    facts = _facts(rows)
    hashes = digest.group_digest(facts, ["match_id"], HASHED)
    counts = facts.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_deliveries"))
    matches = (
        good.join(counts, "match_id", "left").join(hashes, "match_id", "left")
        .fillna(0, ["n_deliveries"]).withColumn("schema_version", F.lit(SCHEMA_VERSION)))
    names = census.registry_names(
        sound.select("match_id", F.col("doc.info.registry.people").alias("people")), "match_id", "people")
    players = census.entity_dimension(
        facts, "match_id", ["striker_id", "non_striker_id", "bowler_id"], "start_date", names
    ).withColumnsRenamed({"entity": "player_id", "n_groups": "n_matches"})
    warn = validate.miscounted_warnings(sound.join(good.select("match_id"), "match_id", "left_semi"))
    return Corpus(facts, sinks.cast_to(matches, MATCH_SCHEMA), sinks.cast_to(players, PLAYER_SCHEMA),
                  quarantine, warn, bounds)


def _fold_tasks(sound: DataFrame) -> int | None:
    """Tasks of the fold by the number of deliveries, so that what one task sorts does not grow with the corpus."""
    overs = F.aggregate("doc.innings", F.lit(0), lambda n, i: n + F.aggregate(
        i["overs"], F.lit(0), lambda k, o: k + F.size(o["deliveries"])))
    n = sound.agg(F.sum(overs)).first()[0] or 0
    return fold.fold_tasks(n, int(sound.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _facts(rows: DataFrame) -> DataFrame:
    c = F.col
    rows = rows.withColumns(events.wicket_columns())
    late = c("innings_idx") > 2
    rows = rows.withColumns({
        "schema_version": F.lit(SCHEMA_VERSION), "is_super_over": late,
        "excluded_from_tuples": late | c("no_result"),
        "outcome_class": outcome_class(
            c("outcome_runs_batter"), c("outcome_wides"), c("outcome_noballs"), c("outcome_byes"),
            c("outcome_legbyes"), c("outcome_n_wickets"))})
    return sinks.cast_to(rows, FACT_SCHEMA)


def corpus_hash(matches: DataFrame) -> DataFrame:
    return digest.corpus_digest(matches, ["match_id", "stream_hash"])


def write(corpus: Corpus, path: str) -> None:
    sinks.write_facts(corpus.facts, f"{path}/deliveries", FACT_SCHEMA)
    sinks.write_dimension(corpus.matches, f"{path}/matches", MATCH_SCHEMA)
    sinks.write_dimension(corpus.players, f"{path}/players", PLAYER_SCHEMA)
    sinks.write_quarantine(corpus.quarantine, f"{path}/quarantine")
