"""Every number that decides a result, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

SEVERITIES = ("info", "low", "medium", "high", "critical")
CATEGORIES = ("authentication", "identity", "link", "content", "attachment", "llm")
CLASSES = ("high-risk", "suspicious", "caution", "low")


@dataclass(frozen=True)
class Scoring:
    """Ceilings, weights, floors and bands of the score, and the factors of softening."""

    ceilings: dict[str, int] = field(default_factory=lambda: {"info": 5, "low": 15, "medium": 35, "high": 65, "critical": 100})
    weights: dict[str, int] = field(default_factory=lambda: {"authentication": 14, "identity": 21, "link": 25, "content": 15, "attachment": 10, "llm": 15})
    floors: dict[str, int] = field(default_factory=lambda: {"critical": 75, "high": 50})
    convergence_floor: int = 75
    convergence_categories: int = 2
    bands: tuple[tuple[int, str], ...] = ((75, "high-risk"), (50, "suspicious"), (25, "caution"), (0, "low"))
    floor_excluded_categories: tuple[str, ...] = ("llm",)
    floor_excluded_ids: tuple[str, ...] = ("authentication.gmail_warning",)
    blockers: tuple[str, ...] = ("identity", "link", "attachment", "authentication")
    softened_factor: float = 0.25
    refutable: tuple[str, ...] = ("content.combo.urgent_credential_request", "content.combo.threat_and_credential_request", "content.combo.billing_update_under_threat")


@dataclass(frozen=True)
class Bounds:
    """How much of a message the rules read; they are part of the rules' meaning. None reads all of it."""

    body: int | None = 200_000
    subject: int | None = 998
    evidence: int = 160
    anchor: int | None = 300
    links: int | None = 300
    attachments: int | None = 60
    parties: int | None = 60
    hops: int = 3
    findings_per_rule: int = 3
    language_window: int | None = 2_000
    hidden_chars: int = 600
    bulk_links: int = 12
    prompt_body: int | None = 4_000
    prompt_header: int | None = 300


SCORING, BOUNDS = Scoring(), Bounds()
