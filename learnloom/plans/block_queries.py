"""The per-learner queries again with blocks so small that every learner spans several.

The plain queries see at most a few hundred answers per learner, so one block each; these run
the carries, halos and chained folds that a long history needs. Oracles are unchanged.
"""

from __future__ import annotations

from learnloom.plans.registry import ORACLE, PLANS, query

ROWS = 20  # answers of a block
NAMES = [
    "guess_threshold_pit_min3", "review_schedule", "mastery_walk", "misconception_fold", "replay_results", "replay_skill_state", "replay_resumed",
    "retry_outcomes", "recurrence_flags", "running_totals", "badge_unlocks", "reserve_events", "cooldown_filter",
]


def register(name: str) -> None:
    plan = PLANS[name]
    query(f"{name}_blocks", ORACLE[name])(lambda t: plan(t.with_block_rows(ROWS)))


for _name in NAMES:
    register(_name)
