"""Every constant of the model, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    clique_cap: int = 40  # people of an organisation that still know each other
    hop_surcharge: float = 2.0
    hub_degree: int = 50
    hub_weight: float = 0.6
    fame_sitelinks: int = 8
    fame_cost: float = 6.0
    shown_routes: int = 3
    generated_routes: int = 24
    unusable_routes: int = 3
    weak_floor: float = 0.5  # a weak tie's stored cost stays that much above the tier below
    fanout: int = 6
    #: Spread of route costs above the best that is searched at first, and its growth in each retry.
    first_slack: float = 3.0
    more_slack: float = 2.0


DEFAULT = Params()
