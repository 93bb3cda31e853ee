"""Driver-side configuration: ``.env`` files, catalog preferences, backend choice."""

from __future__ import annotations

import os
import re
from pathlib import Path


def load_env(path: str | os.PathLike, env: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines into ``env`` (default the process's), never overriding; quotes and comments are dropped."""
    env = os.environ if env is None else env
    found: dict[str, str] = {}
    if not Path(path).is_file():
        return found
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, sep, value = line.strip().partition("=")
        if sep and key and not key.startswith("#"):
            found[key.strip()] = value.strip().strip("\"'")
    for key, value in found.items():
        env.setdefault(key, value)
    return found


# The two settings of a profile that say where attachments are.
PREFS = {"data_dir": "extensions.zotero.dataDir", "linked_base": "extensions.zotero.baseAttachmentPath"}


def profile_prefs(root: str | os.PathLike) -> dict[str, str]:
    """``PREFS`` of the profiles below ``root``: each from the first profile (by name) that has it."""
    found: dict[str, str] = {}
    for prefs in sorted(Path(root).glob("*/prefs.js")):
        pairs = dict(re.findall(r'user_pref\("([^"]+)",\s*"([^"]+)"\)', prefs.read_text(encoding="utf-8", errors="ignore")))
        for name, setting in PREFS.items():
            if setting in pairs:
                found.setdefault(name, pairs[setting])
    return found


def ocr_backend(env: dict[str, str]) -> str:
    """`local` or `http`: the one named, else `http` only where its address is set."""
    named = env.get("OCR_BACKEND", "").strip().lower()
    return named if named in ("local", "http") else "http" if env.get("OCR_API_URL") else "local"
