"""Configuration: defaults, user keys laid over them, and the errors of a run."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

# fixed values: path components that are never scanned
EXCLUDED = (
    ".git", ".idea", ".xcode", ".build", ".swiftpm", "DerivedData", "Pods", "Carthage", "build", "node_modules", ".next", ".nuxt", "dist", ".turbo", "venv",
    ".venv", "env", ".env", "__pycache__", ".tox", "site-packages", "vendor", ".bundle", ".gradle", ".kotlin", "target", ".cache", ".tmp", "tmp", "out", "output",
)


# fixed values: how many merges, environment branches, files and hits a compatible run looks at
COMPAT_LIMITS = {"timed_merges": 50, "compared_merges": 50, "cascade_merges": 3, "environments": 3, "version_files": 1000, "hits_per_file": 100}


class GneissError(Exception):
    """A run that can't go on."""


class PathMissing(GneissError):
    pass


class NotAFolder(GneissError):
    pass


class TooManyFiles(GneissError):
    pass


class BadConfig(GneissError):
    pass


class Exists(GneissError):
    pass


@dataclass
class Config:
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDED))
    extensions: list[str] = field(default_factory=lambda: ["swift"])
    max_files: int = 30_000
    commits: int = 5000
    hotspots: int = 15
    learning_path: int = 20
    months: int = 6
    interval_days: int = 30
    compat: bool = False
    cache: str | None = None
    links: str | None = None
    #: None: all; with compat, None means the numbers of COMPAT_LIMITS.
    timed_merges: int | None = None
    compared_merges: int | None = None
    cascade_merges: int | None = None
    environments: int | None = None
    version_files: int | None = None
    hits_per_file: int | None = None
    ai: dict = field(default_factory=lambda: {"enabled": False, "files": 10, "preview": 3000})

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """The defaults with the file's keys laid over them; unknown keys are errors."""
        if path is None:
            return cls()
        try:
            given = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            raise BadConfig(f"{path}: {e}") from e
        known = {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise BadConfig(f"unknown keys: {', '.join(sorted(unknown))}")
        base = asdict(cls())
        return cls(**{k: (base[k] | v if isinstance(base[k], dict) else v) for k, v in given.items()})

    def limit(self, name: str) -> int | None:
        """A limit's number, None for none."""
        given = getattr(self, name)
        return COMPAT_LIMITS[name] if given is None and self.compat else given

    def create(self, path: str) -> None:
        """Write the configuration, sorted; an existing file is left alone."""
        if Path(path).exists():
            raise Exists(path)
        Path(path).write_text(json.dumps(asdict(self), indent=2, sort_keys=True) + "\n", encoding="utf-8")
