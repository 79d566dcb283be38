"""Settings of the command line, from the environment and a file of ``NAME=value`` lines."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "AFFIDAVIT_"


@dataclass(frozen=True)
class Config:
    """Folders of texts and tables, the roster (lines of JSON), and limits; ``None`` is no limit."""

    corpus: str = "corpus"
    archive: str = "archive"
    roster: str | None = None
    hits: int = 100
    evidence: int = 160
    parallel: int | None = None


def settings(file: str | None = ".env", env: Mapping[str, str] | None = None) -> Config:
    """The defaults, then the file's values, then the environment's; relative folders count from the file's folder.

    A missing file, an empty value, blank lines and comments are no settings; a limit that isn't a number is an error.
    """
    found: dict[str, str] = {}
    if file and Path(file).is_file():
        for line in Path(file).read_text(encoding="utf-8").splitlines():
            name, is_, value = line.partition("=")
            if is_ and not line.lstrip().startswith("#"):
                found[name.strip()] = value.strip().strip("'\"")
    found.update(os.environ if env is None else env)
    out = Config()
    for f in fields(Config):
        value = found.get(PREFIX + f.name.upper())
        if value:
            out = replace(out, **{f.name: int(value) if f.name in ("hits", "evidence", "parallel") else value})
    base = Path(file).resolve().parent if file else Path.cwd()
    place = lambda p: p if p is None or "://" in p else str(base / p)
    return replace(out, corpus=place(out.corpus), archive=place(out.archive), roster=place(out.roster))
