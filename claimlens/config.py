"""Settings of a scan, and the rules that they have to meet."""

from __future__ import annotations

from dataclasses import dataclass, field

from claimlens.operators.references import MODES


@dataclass(frozen=True)
class Settings:
    targets: tuple[str, ...] = ()
    target_file: str | None = None
    directory: str | None = None
    workers: int = 25
    timeout_s: int = 10
    max_rate: float = 30.0
    max_file_kb: int = 10_240
    no_limit: bool = False
    proxy: str | None = None
    proxy_file: str | None = None
    output: str | None = None
    format: str = "text"
    headers: tuple[str, ...] = field(default_factory=tuple)
    mode: str = "regex"
    verbose: bool = False
    silent: bool = False
    registry: str | None = None

    def checked(self) -> Settings:
        """These settings, or ValueError for combinations that exclude each other."""
        if self.proxy and self.proxy_file:
            raise ValueError("give one proxy or a proxy file, not both")
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if self.format not in ("text", "json"):
            raise ValueError("format is text or json")
        return self

    @property
    def has_input(self) -> bool:
        return bool(self.targets or self.target_file or self.directory)
