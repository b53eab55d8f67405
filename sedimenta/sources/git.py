"""Clones of repositories, made on the driver before files are read. Not an operator: one call for one tree."""

from __future__ import annotations

import os
import re
import subprocess

TIMEOUT = 120


def scrub(message: str, token: str) -> str:
    return message.replace(token, "***") if token else message


def clone(url: str, folder: str, token: str = "", branch: str = "", depth: int = 1, timeout: int = TIMEOUT) -> str:
    """Clone url into folder, without prompts, and return the folder; what a failure says has no token in it."""
    source = re.sub(r"^(https?://)", lambda m: f"{m[1]}{token}@", url) if token else url
    command = ["git", "clone", "--depth", str(depth), *(["--branch", branch] if branch else []), "--", source, folder]
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    except subprocess.TimeoutExpired:
        raise RuntimeError(f"cloning took more than {timeout} s") from None
    if done.returncode:
        raise RuntimeError(scrub(done.stderr.strip(), token))
    return folder
