"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Stored columns and types, in order.
FACT_SCHEMA = (
    T.StructType()
    .add("schema_version", "string")
    .add("match_id", "string")
    .add("fmt", "string")
    .add("gender", "string")
    .add("venue_id", "string")
    .add("start_date", "date")
    .add("competition", "string")
    .add("temporal_split", "string")
    .add("innings_idx", "integer")
    .add("over_number", "integer")
    .add("ball_in_over", "integer")
    .add("batting_team", "string")
    .add("bowling_team", "string")
    .add("balls_per_over", "integer")
    .add("max_balls", "integer")
    .add("legal_balls", "integer")
    .add("runs", "integer")
    .add("wickets", "integer")
    .add("striker_id", "string")
    .add("striker_runs", "integer")
    .add("striker_balls", "integer")
    .add("non_striker_id", "string")
    .add("non_striker_runs", "integer")
    .add("non_striker_balls", "integer")
    .add("bowler_id", "string")
    .add("bowler_legal_balls", "integer")
    .add("bowler_runs_conceded", "integer")
    .add("bowler_wickets", "integer")
    .add("target", "integer")
    .add("dls_applied", "boolean")
    .add("in_powerplay", "boolean")
    .add("partnership_runs", "integer")
    .add("partnership_balls", "integer")
    .add("fow_last_runs", "integer")
    .add("fow_last_ball", "integer")
    .add("last_ball_was_noball", "boolean")
    .add("is_super_over", "boolean")
    .add("excluded_from_tuples", "boolean")
    .add("outcome_class", "string")
    .add("outcome_runs_batter", "integer")
    .add("outcome_runs_extras", "integer")
    .add("outcome_runs_total", "integer")
    .add("outcome_wides", "integer")
    .add("outcome_noballs", "integer")
    .add("outcome_byes", "integer")
    .add("outcome_legbyes", "integer")
    .add("outcome_penalty", "integer")
    .add("outcome_n_wickets", "integer")
    .add("outcome_wicket_kinds", "string")
    .add("outcome_players_out", "string")
)
MATCH_SCHEMA = (
    T.StructType()
    .add("schema_version", "string")
    .add("match_id", "string")
    .add("fmt", "string")
    .add("gender", "string")
    .add("venue_id", "string")
    .add("start_date", "date")
    .add("competition", "string")
    .add("temporal_split", "string")
    .add("team1", "string")
    .add("team2", "string")
    .add("balls_per_over", "long")
    .add("scheduled_overs", "long")
    .add("outcome_result", "string")
    .add("outcome_winner", "string")
    .add("outcome_method", "string")
    .add("outcome_eliminator", "string")
    .add("outcome_bowl_out", "string")
    .add("dls_applied", "boolean")
    .add("no_result", "boolean")
    .add("toss_uncontested", "boolean")
    .add("has_super_over", "boolean")
    .add("n_innings", "long")
    .add("n_deliveries", "long")
    .add("stream_hash", "string")
)
PLAYER_SCHEMA = (
    T.StructType()
    .add("player_id", "string")
    .add("name", "string")
    .add("n_matches", "long")
    .add("first_seen", "date")
    .add("last_seen", "date")
)
