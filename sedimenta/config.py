"""Settings from the environment, or else from a file of NAME=value lines."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from sedimenta.functions import text as X


def read_env_file(path: str | Path) -> dict[str, str]:
    """NAME=value lines of a file; empty if there is none. Comments, blank lines, export and quotes around values are let be."""
    out, file = {}, Path(path)
    for line in file.read_text(encoding="utf-8").splitlines() if file.is_file() else []:
        name, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and name and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value.partition(" #")[0].strip()
    return out


@dataclass
class Config:
    """Names of the environment are those of the fields, in capitals and with the prefix that settings() is given."""

    api_key: str = ""
    model: str = ""
    max_output_tokens: int = 8192
    temperature: float = 0.0
    max_tokens_per_chunk: int = 8000
    chars_per_token: float = X.CHARS_PER_TOKEN
    include_tests: bool = False
    output_path: str = "output"
    cache_path: str = "output/cache"
    repo_path: str = ""


#: Names in the environment; fixed values.
NAMES = {
    "api_key": "ANTHROPIC_API_KEY",
    "model": "LLM_MODEL",
    "max_output_tokens": "LLM_MAX_OUTPUT_TOKENS",
    "temperature": "LLM_TEMPERATURE",
    "max_tokens_per_chunk": "MAX_TOKENS_PER_CHUNK",
    "chars_per_token": "CHARS_PER_TOKEN",
    "include_tests": "INCLUDE_TESTS",
    "output_path": "OUTPUT_PATH",
    "cache_path": "CACHE_PATH",
    "repo_path": "REPO_PATH",
}


def settings(env_file: str | Path = ".env", environment: Mapping[str, str] | None = None, placeholders: tuple[str, ...] = ("your-key-here", "")) -> Config:
    """What the environment says, else the file, else the default. A key that only stands in for one counts as none."""
    found = read_env_file(env_file) | dict(os.environ if environment is None else environment)
    out = Config()
    for name, source in NAMES.items():
        if source in found:
            kind, raw = type(getattr(out, name)), found[source].strip()
            setattr(out, name, raw.lower() == "true" if kind is bool else kind(raw))
    out.api_key = "" if out.api_key.strip() in placeholders else out.api_key.strip()
    return out
