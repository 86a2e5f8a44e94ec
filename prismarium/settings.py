"""Settings (TOML with sections) and session (JSON) of a photo library; plain Python."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


def config_dir() -> str:
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "prismarium")


def _fill(kind: type, data: object):
    """A dataclass from a mapping: unknown keys are ignored, missing ones get the defaults, sections nest."""
    if not isinstance(data, dict):
        return kind()
    out = kind()
    for f in fields(kind):
        if f.name in data:
            now = getattr(out, f.name)
            value = _fill(type(now), data[f.name]) if is_dataclass(now) else data[f.name]
            if now is not None and not is_dataclass(now) and not isinstance(value, (type(now), int) if isinstance(now, float) else type(now)):
                raise ValueError(f"{f.name} is {value!r}")
            setattr(out, f.name, value)
    return out


@dataclass
class GroupingConfig:
    similarity_threshold: float = 0.92
    preserve_folder_structure: bool = False
    verify_checksum: bool = True
    thumbnail_size: int = 256


@dataclass
class Session:
    """What the user chose last."""

    source: str | None = None
    destination: str | None = None
    config: GroupingConfig = field(default_factory=GroupingConfig)

    @staticmethod
    def load_from(path: str | Path) -> Session:
        """An unreadable or broken file gives the defaults."""
        try:
            return _fill(Session, json.loads(Path(path).read_text()))
        except (OSError, ValueError):
            return Session()

    def save_to(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    def validate_paths(self) -> None:
        """Forgets folders that are gone."""
        for name in ("source", "destination"):
            at = getattr(self, name)
            if at is not None and not os.path.isdir(at):
                setattr(self, name, None)


@dataclass
class DescriptionSettings:
    enabled: bool = False
    server_url: str = "http://localhost:1234"
    model: str = "local-model"
    prompt: str = "Say in detail what this picture shows: subjects, scene, colours, mood, visible text, and whatever helps to find it."


@dataclass
class FaceSettings:
    enabled: bool = False
    detector_type: str = "atksh"
    detector_model: str = ""
    embedder_model: str = ""
    similarity_threshold: float = 0.40
    tagging_top_k: int = 5
    device: str = "cpu"

    def models_available(self) -> bool:
        return bool(self.detector_model) and os.path.exists(self.detector_model)

    def embedder_path(self) -> str | None:
        return self.embedder_model if self.embedder_model and os.path.exists(self.embedder_model) else None


@dataclass
class CollectionSettings:
    add_hotkey: str = "a"


@dataclass
class Settings:
    debug: bool = False
    preview_buffer_size: int = 21
    library_dir: str = ""
    database_path: str = ""
    folder_format: str = "%Y/%m"
    ai: DescriptionSettings = field(default_factory=DescriptionSettings)
    face: FaceSettings = field(default_factory=FaceSettings)
    collections: CollectionSettings = field(default_factory=CollectionSettings)

    def __post_init__(self) -> None:
        self.fill_empty_paths()

    def fill_empty_paths(self) -> None:
        self.library_dir = self.library_dir or config_dir()
        self.database_path = self.database_path or os.path.join(config_dir(), "library")

    @staticmethod
    def load_from(path: str | Path) -> Settings:
        """A missing file is made from the defaults, a broken one gives them."""
        at = Path(path)
        if not at.exists():
            made = Settings()
            made.save_to(at)
            return made
        try:
            out = _fill(Settings, tomllib.loads(at.read_text()))
        except (OSError, ValueError):
            return Settings()
        out.fill_empty_paths()
        return out

    def save_to(self, path: str | Path) -> None:
        at = Path(path)
        at.parent.mkdir(parents=True, exist_ok=True)
        data = asdict(self)
        lines = [f"{k} = {json.dumps(v)}" for k, v in data.items() if not isinstance(v, dict)]
        for name, section in data.items():
            if isinstance(section, dict):
                lines += ["", f"[{name}]", *(f"{k} = {json.dumps(v)}" for k, v in section.items())]
        at.write_text("\n".join(lines) + "\n")
