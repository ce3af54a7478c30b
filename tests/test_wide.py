"""The wide columns over two small hands, with values worked out by hand from their definitions."""

from datetime import datetime, timedelta

import pytest
from dyadlake.plans import interactions as plays
from dyadlake.plans import wide
from pyspark.sql import functions as F

STEP = 759375
#: hand, player, street, action, cents
LOG = [
    (1, 1, 0, "raise", 100), (1, 2, 0, "call", 100), (1, 3, 0, "fold", 0), (1, 1, 1, "bet", 50), (1, 2, 1, "raise", 500), (1, 1, 1, "fold", 0), (1, 2, 3, "check", 0),
    (2, 1, 0, "check", 0), (2, 2, 0, "check", 40), (2, 1, 1, "check", 0), (2, 2, 1, "check", 0),
]
#: player (who holds the part of that number), points, flop, turn, final: categories 2, 2, 3; 0, 1, 1; 0, 0, 2
CARDS = [(1, 10.0, 2 * STEP + 5, 2 * STEP + 5, 3 * STEP), (2, 4.0, 100, STEP, STEP + 1), (3, 7.0, 50, 60, 2 * STEP)]
#: Paid 150, 600, 0 of 750 by three: nets -300, 1050, -750. Shares of actions by street and what is faced: raise 1/3 at first, call 1/2, bet and raise 1/4 on street 1, the others certain.
FIRST = {
    "flow": {"signed_net_diff": -1350, "net_gap": 1350, "transfer_12": 300, "transfer_21": 0, "transfer_any": 300, "transfer_pot_ratio": 0.133274, "partner_won_other_lost": 1, "loser_is_p1": 1, "transfer_x_call": 300},
    "joint": {"both_vpip": 1, "both_post_in": 1, "both_showdown": 0, "one_folded": 1, "n_vpip": 2, "n_pfr": 1, "n_in_blinds": 2, "faced_raise_any": 1},
    "sums": {"pair_aggr": 3, "pair_raise": 2, "pair_call": 1, "pair_check": 1, "pair_postflop_check": 1, "n_partners_aggr": 2, "max_amount": 500, "pair_last_street": 3, "pair_contrib": 750},
    "policy": {"loose_sum": 1791759, "loose_min": 693147, "loose_max": 1098612, "tight_max": 0, "loose_pfr_sum": 1098612, "junk_vpip_sum": 1, "junk_vpip_min": 0, "junk_pfr_sum": 0, "vpip_resid_sum": 1166667, "points_max": 10, "points_min": 4},
    "entrant": {"second_points": 4, "second_loose": 693147, "second_surp": 2079441, "both_vpip_junk": 0, "one_junk": 1, "second_entrant_junk": 1, "both_surprising": 0, "junk_raise": 0},
    "surprise": {"surp_pair_sum": 4564347, "surp_pair_min": 2079441, "surp_pair_max": 2484906, "surp_pf_sum": 1791759, "surp_post_sum": 2772588, "surp_fold_sum": 0, "surp_call_sum": 693147, "surp_raise_sum": 2484906, "n_surp2_sum": 0, "both_surp2": 0, "p_min_pair": 0.25, "logp_mean_sum": -1.521449, "both_vpip_surp2": 0},
    "strength": {"loser_points": 10, "winner_points": 4, "points_gap": 6, "loser_flop": 2 * STEP + 5, "winner_turn": STEP, "loser_beats_winner_flop": 1, "loser_beats_winner_turn": 1, "loser_beats_winner_final": 1, "loser_best_final": 1, "winner_best_final": 0, "cat_gap": 2, "max_cat": 3, "fold_better_hand": 1, "both_made_no_aggr": 0, "winner_weak_won": 1},
    "interaction": {"fold_to_partner": 1, "call_to_partner": 1, "raise_to_partner": 0, "fold_to_other": 0, "call_to_other": 0, "fold_to_partner_pf": 0, "call_to_partner_pf": 1, "fold_to_partner_by_first": 1, "call_to_partner_by_first": 0, "fold_to_partner_late": 0, "hu_check": 0, "overbets": 0, "n_facing_partner": 2, "surp_to_partner": 693147, "surp_to_other": 0},
    "outsiders": {"outsider_fold": 1, "outsider_call": 0, "outsider_raise": 0, "outsider_fold_pf": 1, "outsider_call_pf": 0, "outsider_raise_pf": 0},
    "anatomy": {"fold_stronger_to_partner": 1, "fold_better_to_partner": 1, "both_strong_no_raise": 0, "multi_call": 0, "squeeze": 1, "squeeze_pf": 0, "squeeze_then_fold": 1, "squeeze_then_fold_pf": 0, "dump": 1, "dump_better_hand": 1, "checkdown": 0, "hu_checkdown_strong": 0, "hu_check_two_pair_plus": 0},
    "made": {"decisive_street": 1, "who_folded": 1, "loser_cat_flop": 2, "winner_cat_flop": 0, "loser_cat_reached": 2, "winner_cat_reached": 1, "cat_gap_reached": 1, "cat_gap_final": 2, "min_cat_turn": 1, "improved_1": 1, "improved_2": 1, "outsider_category": 2, "pair_beats_outsiders": 1, "both_beat_outsiders": 0, "weaker_isolates": 0, "folder_category": 2, "stayer_category": 1, "combo_both": 28, "combo_roles": 47, "combo_outsider": 33},
    "timing": {"fold_first": 1, "fold_last": 99, "loser_fold_street": 1, "winner_fold_street": 99, "loser_last_street": 1, "winner_last_street": 3, "isolate_street": 99, "partner_street": 0, "face_first": 0, "face_last": 1, "odd_first": 99, "active_last": 4, "both_in_s0": 1, "both_in_s1": 0, "outsiders_s0": 4, "outsiders_s1": 3, "outsiders_s3": 2, "heads_up_s1": 0, "surp_sum_s1": 2772588, "surp_max_s0": 1098612, "surp_least_s0": 693147, "acts_sum_s0": 2, "acts_sum_s1": 3, "acts_sum_s3": 1, "loser_surp_s0": 1098612, "loser_acts_s1": 2, "acted_alone_s3": 1, "acted_alone_s1": 0},
    "own_policy": {"own_sum": 3774038, "own_most": 1134980, "own_least": 1134980, "own_p_min": 0.321429, "own_n_rare": 0, "own_n_rarest": 0, "own_both_rare": 0, "own_loser": 2100061, "own_winner": 1673977, "own_delta": -790309, "own_delta_max": -384845, "own_delta_min": -405464, "own_pf_sum": 1504078, "own_post_sum": 2269960, "own_to_partner": 538997, "own_to_other": 0, "own_most_to_partner": 538997, "own_fold_to_partner": 0, "own_call_to_partner": 538997, "own_raise_to_partner": 0, "own_delta_partner": -154150},
    "notebook": {"is_pure_dump": 1, "soft_checkdown": 0, "squeeze_isolation": 0, "iso_preflop": 0, "late_vs_blind": 0, "dump_from_oop": 1, "partner_calls_dump": 1, "dump_vs_hole": 300, "strong_hole_passive": 0, "passivity_density": 0.333333, "opposite_net_sign": 1, "outsider_fold_then_pair": 1},
    "residuals": {"strength_1": 0.333333, "strength_2": 0.111111, "strength_gap": 0.222222, "fold_resid_1": 0.133333, "raise_resid_1": 0.133333, "check_resid_1": -0.4, "call_resid_2": 0.133333, "check_resid_2": -0.266667, "weighted_passivity": 0.0, "transfer_x_gap": 0.006667, "fold_strength": 0.333333, "semantic_directed": 4.158883, "semantic_soft": 0.0, "semantic_isolation": 3},
    "heuristics": {"directed_signal": 2.136294, "soft_signal": 1.0, "isolation_signal": 2.0, "directed_priority": 1.612426, "soft_priority": 0.166667, "isolation_priority": 1.0, "score_v2": 2.819673, "relevance": 67.25, "relevance_flow": 4.125},
}
#: Nets -40 and 40 of 40 by two; nobody else is there.
SECOND = {
    "flow": {"transfer_12": 40, "transfer_x_call": 0}, "joint": {"both_vpip": 0, "one_folded": 0}, "sums": {"pair_check": 4, "pair_aggr": 0}, "policy": {"loose_sum": 0, "tight_max": 405465}, "strength": {"both_made_no_aggr": 1, "fold_better_hand": 0, "loser_best_final": 1},
    "outsiders": {"outsider_fold": 0}, "anatomy": {"checkdown": 1, "dump": 0, "squeeze": 0}, "made": {"outsider_category": -1, "combo_outsider": 30, "who_folded": 0, "folder_category": -1}, "notebook": {"soft_checkdown": 1, "is_pure_dump": 0, "strong_hole_passive": 1, "passivity_density": 1.0},
    "residuals": {"weighted_passivity": 0.444445}, "heuristics": {"soft_signal": 2.0, "relevance": 1.0}, "surprise": {"surp_pair_sum": 2 * (405465 + 693147)},
}
#: The pair of the raiser and the one who folded first: the caller is their outsider.
OTHERS = {"interaction": {"fold_to_partner": 1, "fold_to_other": 1, "call_to_partner": 0}, "outsiders": {"outsider_call": 1, "outsider_call_pf": 1, "outsider_fold": 0}, "anatomy": {"dump": 0, "squeeze": 0}, "flow": {"transfer_12": 0, "transfer_21": 0}}


@pytest.fixture
def small_hands(spark, monkeypatch):
    start = datetime(2024, 1, 1)
    rows = [(i, h, 0, start + timedelta(minutes=i), p, s, a, c) for i, (h, p, s, a, c) in enumerate(LOG)]
    log = spark.createDataFrame(rows, "event_id long, hand_id long, table_id long, ts timestamp, player_id long, street int, action string, amount long")
    monkeypatch.setattr(plays, "log", lambda *_: log)
    monkeypatch.setattr(wide, "acts", wide._acts)
    monkeypatch.setattr(wide, "judged", wide._judged)
    monkeypatch.setattr(wide, "cards", lambda *_: spark.createDataFrame(CARDS, "part long, points double, flop long, turn long, final long"))
    monkeypatch.setattr(wide, "part_of", lambda *_: F.col("player_id"))


@pytest.mark.parametrize("family", list(FIRST))
def test_values_worked_out_by_hand(spark, small_hands, family):
    got = {(r.hand_id, r.p1, r.p2): r for r in wide.pair_hands(spark, "", family).collect()}
    assert set(got) == {(1, 1, 2), (1, 1, 3), (1, 2, 3), (2, 1, 2)}
    for key, wanted in (((1, 1, 2), FIRST), ((2, 1, 2), SECOND), ((1, 1, 3), OTHERS)):
        for c, v in wanted.get(family, {}).items():
            assert float(got[key][c]) == pytest.approx(v, abs=1e-9), (key, c)


def test_contrasts_and_ranks_worked_out_by_hand(spark, small_hands):
    got = {(r.p1, r.p2): r for r in wide.pair_contrasts(spark, "").collect()}
    assert got[1, 2].n == 2 and got[1, 2].n_raise_pf_sum == pytest.approx((0.5 + 0.5) * 2 / 27, abs=1e-6)  # no hand without the partner: a field of 0
    # one of the first player's two hands is shared with the third: 1 raise in it, none in the other; the third has one hand, one fold
    assert got[1, 3].n == 1 and got[1, 3].n_raise_pf_gap == pytest.approx(1 / 26, abs=1e-6) and got[1, 3].n_fold_pf_sum == pytest.approx(2 / 26, abs=1e-6)
    assert got[1, 3].n_fold_pf_min == pytest.approx(1 / 26, abs=1e-6) and got[1, 3].net_pf_min == pytest.approx(-750 / 26, abs=1e-6)
    ranks = {(r.hand_id, r.p1, r.p2): r for r in wide.hand_normalised(spark, "").collect()}
    assert (ranks[1, 1, 2].transfer_any_prank, ranks[2, 1, 2].transfer_any_prank, ranks[2, 1, 2].both_showdown_prank) == (1.0, 0.5, 0.75)
    assert ranks[2, 1, 2].transfer_any_to_max == pytest.approx(40 / 300, abs=1e-6) and ranks[1, 2, 3].dump_prank == 1.0


def test_scores_worked_out_by_hand(spark, small_hands):
    r = {(r.p1, r.p2): r for r in wide.pair_scores(spark, "").collect()}[1, 2]
    assert (r.n, r.relevance_max, r.relevance_sum, r.relevance_top3) == (2, 67.25, 68.25, 34.125)
    assert (r.transfer_rate, r.transfer_dominant, r.call_partner_asym, r.fold_partner_asym, r.relevance_same_loser) == (170.0, 340, 0.5, 0.5, 1.0)
    assert r.consistency == pytest.approx(1430 / 1431, abs=1e-6) and r.relevance_burst_max == 67.25 and r.relevance_burst_excess == pytest.approx(67.25 - 34.125)
