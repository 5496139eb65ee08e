"""Default metric lists, codes and points.

Fixed values: they must be these for the same results, and are stated in natural order.
"""

from __future__ import annotations

# Metrics averaged over a window.
MEAN_METRICS = [
    "total_points", "minutes", "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded", "ict_index", "influence",
    "creativity", "threat", "clean_sheets", "goals_conceded", "saves", "tackles", "clearances_blocks_interceptions", "recoveries", "defensive_contribution",
    "xg", "xa", "xg_chain", "xg_buildup", "key_passes", "shots", "value", "selected", "transfers_in", "transfers_out", "form", "yellow_cards", "red_cards",
    "own_goals", "penalties_missed", "penalties_saved",
]
# Metrics summed over a window.
SUM_METRICS = ["goals_scored", "assists", "bonus"]
# Columns that are no metrics (names of ids in a source are the caller's to exclude).
NO_METRICS = frozenset([
    "player_id", "gameweek", "fixture_id", "opponent_team_id", "was_home", "kickoff_time", "season", "name", "web_name", "position", "team", "element_type",
    "status", "modified", "fixture", "round", "GW", "element", "player", "league_id", "season_id", "team_id", "game_id", "position_id",
    "clean_sheets_per_90", "goals_conceded_per_90", "saves_per_90", "expected_goals_conceded_per_90", "expected_goals_per_90", "expected_assists_per_90",
    "expected_goal_involvements_per_90", "defensive_contribution_per_90", "now_cost_rank", "now_cost_rank_type", "points_per_game_rank",
    "points_per_game_rank_type", "form_rank", "form_rank_type", "selected_rank", "selected_rank_type", "ict_index_rank", "ict_index_rank_type",
    "influence_rank", "influence_rank_type", "creativity_rank", "creativity_rank_type", "threat_rank", "threat_rank_type", "news", "photo", "code",
    "opta_code", "scout_news_link", "birth_date", "team_join_date", "corners_and_indirect_freekicks_text", "direct_freekicks_text", "penalties_text",
])
WINDOWS = (3, 5, 10)
# Rows of a form window by its name.
FORM_WINDOWS = {"7d": 3, "14d": 6, "30d": 10}
# Metrics of a pair of teams.
TEAM_PAIR_MEANS = [
    "home_xg", "away_xg", "home_goals", "away_goals", "home_shots", "away_shots", "home_ppda", "away_ppda", "home_deep_completions", "away_deep_completions",
    "home_expected_points", "away_expected_points", "home_np_xg", "away_np_xg",
]
TEAM_PAIR_SUMS = ["home_goals", "away_goals"]
# Position codes.
POSITIONS = {
    "GKP": "GKP", "GK": "GKP", "GOALKEEPER": "GKP", "G": "GKP", "DEF": "DEF", "D": "DEF", "DC": "DEF", "DL": "DEF", "DR": "DEF", "MID": "MID", "M": "MID",
    "MC": "MID", "ML": "MID", "MR": "MID", "DMC": "MID", "DML": "MID", "DMR": "MID", "FWD": "FWD", "F": "FWD", "FW": "FWD", "AMC": "FWD", "AML": "FWD", "AMR": "FWD",
}
ELEMENT_TYPES = {1: "GKP", 2: "DEF", 3: "MID", 4: "FWD"}
# Team names of one source in another.
TEAM_NAMES = {
    "Man City": "Manchester City", "Man Utd": "Manchester United", "Newcastle": "Newcastle United", "Spurs": "Tottenham",
    "Wolves": "Wolverhampton Wanderers", "Nott'm Forest": "Nottingham Forest", "Bournemouth": "Bournemouth", "Sheffield Utd": "Sheffield United",
}
# Points.
GOAL_POINTS, OTHER_GOAL_POINTS = {"GK": 6, "DEF": 6, "MID": 5, "FWD": 4}, 4
CLEAN_SHEET_POINTS = {"GK": 4, "DEF": 4, "MID": 1, "FWD": 0}
POINTS = {"assists": 3, "yellow_cards": -1, "red_cards": -3, "penalty_save": 5, "penalty_miss": -2, "bonus": 1}
BPS_WEIGHTS = {
    "goals": 24, "assists": 12, "clean_sheet": 12, "goals_conceded": -2, "tackles": 2, "interceptions": 4, "clearances": 2, "key_passes": 3,
    "yellow_cards": -3, "red_cards": -9, "penalty_save": 15, "penalty_miss": -6,
}
# Steps and confidences of matching players between sources.
EXACT, SAME_TEAM_FLOOR, SAME_TEAM_BOOST, LAST_NAME, LAST_NAME_DEFENCE = 1.0, 0.40, 0.2, 0.65, 0.55
OTHER_TEAM_FLOOR, OTHER_TEAM_FACTOR, TRANSFER, REVIEW_BELOW = 0.45, 0.7, 0.9, 0.85
# Contract of a player row.
FIRST_GAMEWEEK, LAST_GAMEWEEK = 1, 38
