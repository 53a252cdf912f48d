"""Profiles and policies: driver-side values that become literals of a plan."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, replace
from functools import cache
from pathlib import Path

from ferrule.functions import text


@dataclass(frozen=True)
class Structure:
    """Patterns that a chunker goes by; None switches a feature off."""

    question: str | None = None
    section: str | None = None
    clause: str | None = None
    #: Pattern and the chunk field its finds go to.
    references: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Profile:
    name: str
    answer_framing: str
    prompts: dict[str, str] = field(default_factory=dict)
    structure: Structure = Structure()
    suggested_questions: tuple[str, ...] = ()


CONTRACT_STRUCTURE = Structure(text.QUESTION_HEADER, text.SECTION_HEADER, text.CLAUSE_HEADER, ((text.DRAWING_REF, "drawing_refs"), (text.CLAUSE_REF, "clause_refs")))
CONTRACT = Profile("contract", "You answer questions about a construction contract, from the passages given and nothing else.", structure=CONTRACT_STRUCTURE)
DOCUMENT = Profile("document", "You answer questions about a set of documents, from the passages given and nothing else.")
_BUILT_IN = {p.name: p for p in (CONTRACT, DOCUMENT)}
_PROMPTS = ("ocr_text_prompt", "ocr_drawing_prompt", "caption_prompt")
PROFILE_DIR = "FERRULE_PROFILES"


def _profile(path: Path) -> Profile:
    import yaml

    raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    if not isinstance(raw, dict):
        raise ValueError(f"{path.name}: not a mapping")
    missing = [k for k in ("name", "answer_framing", *_PROMPTS, "structure") if k not in raw]
    if missing:
        raise ValueError(f"{path.name}: missing {', '.join(missing)}")
    s = raw["structure"] or {}
    rules = tuple((r["pattern"], r["target_field"]) for r in s.get("ref_rules") or ())
    for pattern in (*(s.get(k) for k in ("qa_block_pattern", "section_header_pattern", "clause_header_pattern")), *(p for p, _ in rules)):
        if pattern:
            re.compile(pattern)
    structure = Structure(s.get("qa_block_pattern"), s.get("section_header_pattern"), s.get("clause_header_pattern"), rules)
    return Profile(raw["name"], raw["answer_framing"], {k: raw[k] for k in _PROMPTS}, structure, tuple(raw.get("suggested_questions") or ()))


@cache
def load_profile(name: str = "contract", folder: str | None = None) -> Profile:
    """A profile of the folder (or that named by the environment), else one that is built in."""
    folder = folder or os.environ.get(PROFILE_DIR)
    if folder and (path := Path(folder, f"{name}.yaml")).exists():
        return _profile(path)
    if name not in _BUILT_IN:
        raise ValueError(f"no profile {name!r}; there are: {', '.join(available_profiles(folder))}")
    return _BUILT_IN[name]


def available_profiles(folder: str | None = None) -> list[str]:
    folder = folder or os.environ.get(PROFILE_DIR)
    return sorted({*_BUILT_IN, *(p.stem for p in Path(folder).glob("*.yaml"))} if folder else _BUILT_IN)


@dataclass(frozen=True)
class Policy:
    """Toggles and thresholds of the page valves. The defaults are fixed values."""

    rotate: bool = True
    regions: bool = False
    needs_vision_v2: bool = False
    rescue: bool = True
    gate_min_score: float = 0.756
    improvement_factor: float = 1.10
    v2_sparse_cover: float = 0.10
    v2_sparse_dark: float = 0.02
    v2_fragment_box_frac: float = 0.001
    v2_filled_dark_ratio: float = 0.5
    rescue_dpi: int = 300
    rescue_min_score: float = 0.756


def policy_from(values: dict) -> Policy:
    """The defaults with some values replaced; keys that are no field are let be."""
    out = {}
    for f in fields(Policy):
        if f.name in values:
            v = values[f.name]
            kind = type(getattr(Policy, f.name))
            if kind is bool and not isinstance(v, bool):
                raise ValueError(f"{f.name} must be true or false")
            out[f.name] = kind(v)
    return replace(Policy(), **out)


def load_policy(name: str | None = None, folder: str | None = None) -> Policy:
    """A policy by path, by name in a folder, or the built-in default."""
    if not name or name == "default":
        return Policy()
    import yaml

    path = Path(name) if "/" in name or name.endswith((".yaml", ".yml")) else Path(folder or os.environ.get(PROFILE_DIR, "."), f"{name}.yaml")
    if not path.exists():
        raise ValueError(f"no policy {name!r}")
    raw = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    if not isinstance(raw, dict):
        raise ValueError(f"{path.name}: not a mapping")
    return policy_from(raw)
