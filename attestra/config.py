"""Settings of the assessment: every threshold and weight that an operator uses."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace


class StaleVersion(Exception):
    """Someone else wrote the settings first."""


@dataclass(frozen=True)
class Settings:
    version: int = 1
    as_of: str = "2001-11-04"
    factor_weights: dict[str, float] = field(default_factory=lambda: {"track": 0.5, "access": 0.3, "process": 0.2})
    #: class -> factor -> value; a class that is missing has no reliability
    class_factors: dict[str, dict[str, float]] = field(
        default_factory=lambda: {
            "overhead": {"track": 0.95, "access": 0.9, "process": 0.9},
            "registry": {"track": 0.9, "access": 0.8},
            "official": {"track": 0.85, "access": 0.7, "process": 0.8},
            "customs": {"track": 0.8, "process": 0.9},
            "tender": {"track": 0.75, "access": 0.6, "process": 0.7},
            "press": {"track": 0.7, "access": 0.5, "process": 0.5},
            "analyst": {"track": 0.65, "access": 0.4},
            "social": {"track": 0.35, "access": 0.6, "process": 0.1},
        }
    )
    classes: tuple[str, ...] = ("overhead", "registry", "official", "customs", "tender", "press", "analyst", "social", "unlisted")
    penalties: dict[str, float] = field(default_factory=lambda: {"artifact.edited": 0.5, "first_seen.recycled": 0.4, "caption.mismatched": 0.6, "coordination.suspected": 0.3})
    half_lives: dict[str, float] = field(default_factory=lambda: {"supplies": 540.0})
    half_life_defaults: dict[str, float] = field(default_factory=lambda: {"slow": 1825.0})
    freshness_class: dict[str, str] = field(default_factory=lambda: {"supplies": "fast", "equips": "slow", "maintains": "durable"})
    decay_base: float = 2.0
    disciplines: dict[str, str] = field(default_factory=lambda: {"overhead": "imagery", "customs": "trade", "tender": "trade", "registry": "trade"})
    default_discipline: str = "textual"
    aligned: tuple[str, ...] = ("operator", "exporter")
    same_class_weight: float = 0.5
    min_looks: float = 2.0
    confirmed: float = 0.8
    probable: float = 0.5
    supersede_floor: float = 0.5
    fuzzy_floor: float = 60.0
    merge_weights: dict[str, float] = field(default_factory=lambda: {"attribute": 0.5, "relational": 0.3, "temporal": 0.2})
    merge_auto: float = 0.85
    merge_review: float = 0.6
    place_radius_km: float = 400.0
    #: how much a position is trusted, by how it was found
    location_confidence: dict[str, float] = field(default_factory=lambda: {"stated": 1.0, "gazetteer": 0.9, "mention": 0.5, "offset": 0.5})
    #: how far off a position of this precision may be; finest first
    precision_radius_m: dict[str, float] = field(default_factory=lambda: {"pad": 500.0, "site": 1500.0, "terminal": 3000.0, "district": 5000.0, "city": 15000.0, "province": 150000.0})
    #: places of these precisions are things; all coarser ones are areas that many things share
    identity_precisions: tuple[str, ...] = ("pad", "site", "terminal")

    @classmethod
    def load(cls, path: str) -> Settings:
        """From a JSON or YAML document; keys that are missing keep their defaults, unknown ones are ignored."""
        with open(path) as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("reading YAML needs PyYAML") from e
            got = yaml.safe_load(text) or {}
        else:
            got = json.loads(text)
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items() if k in known})

    def updated(self, version: int, **changes) -> Settings:
        """A shallow merge, refused when version isn't the current one."""
        if version != self.version:
            raise StaleVersion(f"version {version} is not {self.version}")
        merged = {k: {**getattr(self, k), **v} if isinstance(v, dict) else v for k, v in changes.items()}
        return replace(self, version=self.version + 1, **merged)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, indent=2) + "\n"


DEFAULT = Settings()
