"""Small dimension files: alias overrides, ingredient aliases, the essential-medicines list."""

from __future__ import annotations

import json
from pathlib import Path

from ..config import parse_simple_yaml

# The essential medicines in scope.
ESSENTIAL_MEDICINES = (
    "amoxicillin", "ceftriaxone", "metronidazole", "artemether-lumefantrine", "oxytocin", "insulin (regular human)", "paracetamol", "ibuprofen",
    "omeprazole", "salbutamol", "atorvastatin", "hydrochlorothiazide", "metformin", "prednisolone", "tenofovir-lamivudine-dolutegravir",
)


def load_overrides(path: str) -> dict[str, list[str]]:
    """canonical name -> aliases, in file order."""
    return {k: [str(x) for x in v] if isinstance(v, list) else [] for k, v in parse_simple_yaml(Path(path).read_text(encoding="utf-8")).items()}


def load_inn(path: str) -> dict[str, str]:
    """alias -> ingredient; keys that begin with an underscore are notes."""
    return {k.lower().strip(): v for k, v in json.loads(Path(path).read_text(encoding="utf-8")).items() if not k.startswith("_")}
