"""Profiles, environment and settings; all on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, replace
from datetime import date
from pathlib import Path

import yaml

SUFFIXES = (".yaml", ".yml", ".json")


@dataclass(frozen=True)
class Profile:
    name: str
    input_path: str | None = None
    output_path: str | None = None
    input_file_regex: str | None = None
    model: str | None = None
    workers: int | None = None
    full_name: str | None = None
    birth_date: str | None = None
    locale: str | None = None

    @classmethod
    def read(cls, path: str | Path) -> Profile:
        """From YAML or JSON; values below ``paths`` win over those beside it. A date that YAML made of a text is a text again."""
        path = Path(path)
        if not path.exists():
            raise FileNotFoundError(f"no profile at {path}")
        text = path.read_text(encoding="utf-8")
        data = (yaml.safe_load(text) if path.suffix in (".yaml", ".yml") else json.loads(text)) or {}
        paths = data.get("paths") or {}
        where = {k: paths.get(k) or data.get(k) or None for k in ("input_path", "output_path", "input_file_regex")}
        rest = {k: data.get(k) for k in ("model", "workers", "full_name", "birth_date", "locale")}
        if isinstance(rest["birth_date"], date):
            rest["birth_date"] = rest["birth_date"].isoformat()
        return cls(name=data.get("name", path.stem), **where, **rest)

    @classmethod
    def find(cls, folder: str | Path, name: str) -> Profile:
        """The profile of a name; YAML comes before JSON."""
        for suffix in SUFFIXES:
            if (path := Path(folder) / f"{name}{suffix}").exists():
                return cls.read(path)
        raise FileNotFoundError(f"no profile {name!r} in {folder}")


def list_profiles(folder: str | Path) -> list[str]:
    """Names in order, without templates, whose names start with an underscore."""
    if not Path(folder).exists():
        return []
    return sorted({p.stem for p in Path(folder).iterdir() if p.suffix in SUFFIXES and not p.name.startswith("_")})


@dataclass(frozen=True)
class Settings:
    """Models, limits and modes of a run."""

    extract_model: str
    classify_model: str
    summarize_model: str
    validation_model: str
    self_consistency_model: str
    api_key: str = ""
    base_url: str = ""
    n_extractions: int = 1
    max_workers: int = 1
    max_input_tokens: int = 100_000
    dry_run: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """From environment values; the extraction model and the key are required, a worker count that is no number is 1."""
        env = dict(os.environ) if env is None else env
        lacking = [k for k in ("EXTRACT_MODEL_ID", "SELF_CONSISTENCY_MODEL_ID", "SUMMARIZE_MODEL_ID", "OPENROUTER_API_KEY") if not env.get(k)]
        if lacking:
            raise ValueError(f"not set: {', '.join(lacking)}")
        extract = env["EXTRACT_MODEL_ID"]
        return cls(
            extract_model=extract,
            classify_model=env.get("CLASSIFY_MODEL_ID") or extract,
            summarize_model=env["SUMMARIZE_MODEL_ID"],
            validation_model=env.get("VALIDATION_MODEL_ID") or extract,
            self_consistency_model=env["SELF_CONSISTENCY_MODEL_ID"],
            api_key=env["OPENROUTER_API_KEY"],
            base_url=resolve_base_url(env.get("OPENROUTER_BASE_URL") or "https://openrouter.ai/api/v1", any(map(os.path.exists, ("/.dockerenv", "/run/.containerenv")))),
            n_extractions=int(env.get("N_EXTRACTIONS") or 1),
            max_workers=max(1, _int(env.get("MAX_WORKERS"), 1)),
            max_input_tokens=int(env.get("SUMMARIZE_MAX_INPUT_TOKENS") or 100_000),
        )

    def overridden(self, profile: Profile, model: str | None = None, workers: int | None = None, dry_run: bool = False) -> Settings:
        """The command line before the profile before the environment. A model replaces all but the validation model."""
        model, workers = model or profile.model, workers or profile.workers
        out = replace(self, dry_run=dry_run or self.dry_run)
        if model:
            out = replace(out, extract_model=model, classify_model=model, summarize_model=model, self_consistency_model=model)
        return replace(out, max_workers=max(1, int(workers))) if workers else out


def _int(text: str | None, default: int) -> int:
    try:
        return int(text) if text else default
    except ValueError:
        return default


def resolve_base_url(url: str, in_container: bool) -> str:
    """Within a container, the host of a local address is the container's host."""
    if not in_container:
        return url
    for local in ("localhost", "127.0.0.1"):
        url = url.replace(f"//{local}", "//host.docker.internal")
    return url


def read_env(folder: str | Path, name: str | None = None) -> dict[str, str]:
    """Values of ``.env``, or of ``.env.NAME`` alone if a name is given, and then of ``.env.local``, which win."""
    out: dict[str, str] = {}
    for file in (f".env.{name}" if name else ".env", ".env.local"):
        path = Path(folder) / file
        if not path.exists():
            if name and file.endswith(name):
                raise FileNotFoundError(f"no {path}")
            continue
        for line in path.read_text(encoding="utf-8").splitlines():
            key, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not key.startswith("#"):
                out[key.strip()] = value.strip().strip("'\"")
    return out
