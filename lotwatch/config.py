"""Rule settings. Thresholds are parameters of every rule; these are the defaults."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Level:
    min_recalls: int
    min_weighted_score: int


@dataclass(frozen=True)
class RepeatViolator:
    window_months: int = 24
    severity_weights: dict[str, int] = field(default_factory=lambda: {"class_1": 3, "class_2": 2, "class_3": 1, "unclassified": 1})
    thresholds: dict[str, Level] = field(default_factory=lambda: {"medium": Level(3, 4), "high": Level(4, 8), "critical": Level(6, 12)})


@dataclass(frozen=True)
class SupplyChain:
    min_county_share_pct: float = 25.0
    min_alternative_suppliers_for_low: int = 3
    time_to_expiry_floor_days: int = 60


@dataclass(frozen=True)
class Corroboration:
    enable: bool = True
    jurisdiction_count_for_boost: int = 2
    boost_levels: int = 1


@dataclass(frozen=True)
class RiskConfig:
    version: str = "1.0"
    repeat_violator: RepeatViolator = field(default_factory=RepeatViolator)
    supply_chain_exposure: SupplyChain = field(default_factory=SupplyChain)
    cross_source_corroboration: Corroboration = field(default_factory=Corroboration)

    @property
    def config_hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def load_config(path: str) -> RiskConfig:
    """Settings from a JSON or YAML file of the same nesting; unknown or missing keys are errors."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        raw = json.loads(text)
    except ValueError:
        raw = parse_simple_yaml(text)
    rv, sc, cc = raw["repeat_violator"], raw["supply_chain_exposure"], raw["cross_source_corroboration"]
    levels = {k: Level(**v) for k, v in rv["thresholds"].items()}
    return RiskConfig(str(raw["version"]), RepeatViolator(rv["window_months"], dict(rv["severity_weights"]), levels), SupplyChain(**sc), Corroboration(**cc))


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_simple_yaml(text: str) -> dict:
    """Nested mappings and lists of scalars by indentation: what the settings and alias files use."""
    root: dict = {}
    stack: list[tuple[int, object, object, str]] = [(-1, root, None, "")]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while stack[-1][0] >= indent:
            stack.pop()
        _, here, above, key = stack[-1]
        if body.startswith("- "):
            if not isinstance(above[key], list):
                above[key] = []
            above[key].append(_scalar(body[2:]))
            continue
        name, _, value = body.partition(":") if not body.endswith(":") else (body[:-1], "", "")
        name = str(_scalar(name))
        if value.strip():
            here[name] = _scalar(value)
        else:
            here[name] = {}
            stack.append((indent, here[name], here, name))
    return root
