"""Settings with their provenance: command line, then environment, then file, then default."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path

from evenfold.schema import DEFAULT, Profile, profile

FILE = "evenfold.yaml"
PROFILE_VAR, LANG_VAR = "EVENFOLD_PROFILE", "EVENFOLD_LANG"


@dataclass(frozen=True)
class Resolved:
    value: object
    source: str


@dataclass(frozen=True)
class Config:
    profile: Resolved
    lang: Resolved
    file: str | None

    def summary(self) -> str:
        p: Profile = self.profile.value  # type: ignore[assignment]
        rows = [("config file", self.file or "(none found)", ""), ("profile", p.kind, self.profile.source), ("lang", self.lang.value, self.lang.source)]
        rows += [(k, v, "") for k, v in p.as_dict().items() if k not in ("kind", "similarity_threshold")]
        return "\n".join(f"{k:<30} {v!s:<20} {'[' + s + ']' if s else ''}".rstrip() for k, v, s in rows)


@dataclass(frozen=True)
class Paths:
    """Where things lie under one root, on whatever file system it names."""

    root: str

    @property
    def store(self) -> str:
        return f"{self.root}/store"

    @property
    def events(self) -> str:
        return f"{self.root}/events"

    def readings(self, run: str = "latest") -> str:
        """What the reader made of the images in one run."""
        return f"{self.root}/readings/{run}"


_ENTRY = re.compile(r"""([A-Za-z_][\w-]*)\s*:(?:\s+(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#"'][^#]*?(?:(?<=\S)#[^#]*?)*)))?\s*(?:(?<=\s)\#.*)?$""")


def read_file(path: Path) -> dict[str, str]:
    """The string settings profile and lang of a YAML file's top level. PyYAML reads it where it is installed; otherwise top-level scalars, plain or quoted, with
    comments after white space, are understood, deeper levels are passed over and a top-level line of another form is an error."""
    text = path.read_text()
    try:
        import yaml
    except ImportError:
        found: dict[str, object] = {}
        for number, line in enumerate(text.splitlines(), 1):
            if not line.strip() or line[0] in " \t-#" or line.strip() in ("---", "..."):
                continue
            m = _ENTRY.match(line.rstrip())
            if not m:
                raise ValueError(f"{path}:{number}: not understood: {line!r}") from None
            quoted, single, plain = m.group(2, 3, 4)
            found[m[1]] = re.sub(r"\\(.)", r"\1", quoted) if quoted is not None else single.replace("''", "'") if single is not None else plain
    else:
        found = yaml.safe_load(text) or {}
        if not isinstance(found, dict):
            raise ValueError(f"{path}: settings must be a mapping")
    return {k: str(found[k]) for k in ("profile", "lang") if found.get(k) not in (None, "")}


def resolve(cli_profile: str | None = None, cli_lang: str | None = None, cli_file: str | None = None, cwd: str = ".", env: dict | None = None) -> Config:
    """Unknown profiles are an error wherever they come from; a missing file is one only if it was asked for."""
    env = os.environ if env is None else env
    path = Path(cli_file) if cli_file else Path(cwd, FILE)
    found = cli_file or path.exists()
    stored = read_file(path) if found else {}

    def pick(cli: str | None, var: str, key: str, default: object) -> Resolved:
        if cli is not None:
            return Resolved(cli, "cli")
        if env.get(var):
            return Resolved(env[var], f"env:{var}")
        if key in stored:
            return Resolved(stored[key], f"file:{path}")
        return Resolved(default, "default")

    name = pick(cli_profile, PROFILE_VAR, "profile", DEFAULT.kind)
    return Config(Resolved(profile(str(name.value)), name.source), pick(cli_lang, LANG_VAR, "lang", "ita"), str(path) if found else None)
