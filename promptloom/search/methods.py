"""Search methods by name: what operators they draw on and how they choose, gate and finish."""

from __future__ import annotations

import dataclasses

@dataclasses.dataclass(frozen=True)
class Method:
    """``choose``: elite, tournament (the best and winners of bouts), bandit (ucb1), tuned or pareto. ``gate``: a minibatch first. ``racing``: dev in parts, without
    who is beaten for sure. ``retention``: children that lose what their parents solved are not admitted. ``holdout``: the
    winner by rows kept apart. ``least_gain``: a generation that gains no more counts as stale."""

    operators: tuple[str, ...]
    choose: str = "elite"
    gate: bool = True
    racing: bool = False
    holdout: bool = False
    retention: bool = False
    least_gain: float = 0.0
    generations: int = 10


_APEX = ("expert_refine", "failure_guided", "crossover", "trajectory", "semantic_var", "few_shot", "format_constraint")
_FUNNEL = (*_APEX, "structured_failure_guided", "local_edit", "reflective_mutation", "midpoint_crossover", "role_assignment", "eda", "lamarckian")
_MUTATORS = ("role_assignment", "expert_persona", "concise_optimization", "task_decomposition", "structural_variation", "constraint_addition", "instruction_expansion", "creative_backstory")
_WIDE = (
    *_FUNNEL, *_MUTATORS[1:], "etgpo_taxonomy", "strago_dual", "multi_aspect_critique", "trajectory_momentum", "autohint", "grips_delete", "grips_swap",
    "grips_add", "grips_paraphrase", "ampo_branch", "facet_edit", "decompose_recompose",
)

METHODS: dict[str, Method] = {
    "baseline_seed": Method((), generations=0),
    "see": Method(("semantic_var", "lamarckian", "crossover", "eda", "failure_guided"), gate=False, least_gain=0.02),
    "swift": Method(("failure_guided", "crossover", "semantic_var", "few_shot"), "tournament"),
    "swift_v2": Method(("failure_guided", "crossover", "semantic_var", "few_shot"), "tournament", holdout=True),
    "apex": Method(_APEX, "bandit", holdout=True), "apex_holdout": Method(_APEX, "bandit", holdout=True),
    "apex_v2": Method(_APEX[:-1], "tuned", holdout=True),
    "apex_lean": Method(_APEX, "bandit", racing=True, holdout=True), "swift_apex_lean": Method(_APEX, "bandit", racing=True, holdout=True),
    "gaapo": Method((*_MUTATORS, "failure_guided", "trajectory", "few_shot", "midpoint_crossover"), racing=True, gate=False),
    "capo": Method(("crossover", "semantic_var", "few_shot"), racing=True, gate=False),
    "gepa": Method(("reflective_mutation", "crossover"), "pareto"),
    "gspe": Method(("facet_edit", "structured_failure_guided"), "tournament"),
    "funnel": Method(_FUNNEL, "bandit"), "funnel_v2": Method(_WIDE, "bandit", holdout=True), "funnel_v3": Method(_WIDE, "bandit", holdout=True),
    "funnel_v4a": Method(_WIDE, "bandit", holdout=True), "funnel_v4b": Method(_WIDE, "bandit", holdout=True), "funnel_v4c": Method(_WIDE, "bandit", holdout=True),
    "funnel_v4d": Method(_WIDE, "bandit", racing=True, holdout=True), "funnel_lean": Method(_WIDE, "bandit", racing=True, holdout=True),
    "funnel_v5": Method(_WIDE, "bandit", racing=True, holdout=True), "funnel_wide": Method(_WIDE, "bandit", racing=True, holdout=True),
    "funnel_v6": Method(_WIDE, "bandit", racing=True, holdout=True), "funnel_indexed": Method(_WIDE, "bandit", racing=True, holdout=True),
    "funnel_v7": Method(_WIDE, "bandit", racing=True, holdout=True), "funnel_prime": Method(_WIDE, "bandit", racing=True, holdout=True),
    "scope": Method(_WIDE, "pareto", holdout=True, retention=True),
    "pact": Method(("facet_edit", "structured_failure_guided", "crossover"), "tournament", retention=True),
}


def method(name: str) -> Method:
    """A registered method; names are not case-sensitive."""
    if name.lower() not in METHODS:
        raise ValueError(f"unknown method: {name}; there are {', '.join(sorted(METHODS))}")
    return METHODS[name.lower()]


def register(name: str, settings: Method) -> None:
    METHODS[name.lower()] = settings
