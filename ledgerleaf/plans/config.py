"""Configuration: defaults, normal forms, validation."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

# What an absent setting means.
DEFAULTS = {"language": "en", "batch_size": 600, "inboxes": [], "exclude": [], "anchors": [], "identifiers": {}, "entities": [], "rules": [], "tags": {}}
LEARNING = {"min_passes": 5, "min_hits": 5, "max_cycles": 3, "dead_after_passes": 10}
# Identifier patterns known without configuration, and the check a name means by default.
PATTERNS = {
    "iban": r"\b[A-Z]{2}\d{2}[ ]?[\dA-Z][\dA-Z ]{10,30}\b",
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b",
}
CHECK_OF = {"siren": "luhn", "siret": "luhn", "iban": "iban"}
LANES = ("route", "propose", "residual", "skip")
STATUSES = ("shadow", "active")


@dataclass(frozen=True)
class IdentifierKind:
    """A kind of identifier: its pattern and the name of the check its values must pass."""

    name: str
    pattern: str
    check: str

    @staticmethod
    def read(name: str, setting: str | Mapping) -> "IdentifierKind":
        """From a pattern alone, or a mapping of pattern and, maybe, validate."""
        more = setting if isinstance(setting, Mapping) else {"pattern": setting}
        return IdentifierKind(name, more.get("pattern") or "", more.get("validate", CHECK_OF.get(name, "none")))


def identifier_kinds(settings: Mapping | None = None) -> list[IdentifierKind]:
    """Known kinds and configured ones, which take the place of known ones of their name; those of the longest
    patterns first, as a long pattern must not lose digits to a short one. An empty pattern switches a kind off."""
    kinds = {name: IdentifierKind.read(name, setting) for name, setting in (PATTERNS | dict(settings or {})).items()}
    return sorted((k for k in kinds.values() if k.pattern), key=lambda k: len(k.pattern), reverse=True)


def load(path: str) -> dict:
    """A configuration file (YAML where a parser is installed, else JSON) with defaults; ``root`` is required."""
    raw = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        data = yaml.safe_load(raw)
    except ImportError:
        data = json.loads(raw)
    return normal(data or {})


def normal(config: dict) -> dict:
    """Defaults filled in; inboxes as {path, policy}; identifiers as {pattern, validate?}."""
    if not config.get("root"):
        raise ValueError("the configuration names no root")
    out = {**DEFAULTS, **config, "learning": {**LEARNING, **(config.get("learning") or {})}}
    out.setdefault("workspace", f"{out['root'].rstrip('/')}/.triage")
    out["inboxes"] = [{"path": x} if isinstance(x, str) else x for x in out["inboxes"] or []]
    out["identifiers"] = {k: {"pattern": v} if isinstance(v, str) else v for k, v in (out["identifiers"] or {}).items()}
    return out


def inert_rules(config: dict) -> list[str]:
    """Ids of rules whose status means nothing: they neither act nor learn."""
    return [r["id"] for r in config.get("rules") or [] if r.get("status", "shadow") not in STATUSES]


def walk_roots(config: dict) -> list[str]:
    """The root and each inbox outside it; a root inside another is folded into it."""
    tops = [config["root"].rstrip("/")]
    for inbox in config.get("inboxes") or []:
        p = inbox["path"] if isinstance(inbox, dict) else inbox
        p = str(Path(p).expanduser())
        tops.append((p if p.startswith("/") else f"{tops[0]}/{p}").rstrip("/"))
    within = lambda a, b: [s.casefold() for s in a.split("/")][: len(b.split("/"))] == [s.casefold() for s in b.split("/")]
    return [t for i, t in enumerate(tops) if not any(within(t, o) and (o != t or j < i) for j, o in enumerate(tops) if j != i)]
