"""What a run can be told: limits, intervals, attempts and optional stages, from an environment, a file of such lines or Spark's configuration."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


@dataclass(frozen=True)
class Settings:
    chunk_char_limit: int = 6000
    missing_block_tolerance: int = 2
    chunk_max_retries: int = 3
    chunk_fix_max_retries: int = 3
    concurrency: int = 10
    pre_pass_frame_interval_seconds: int = 120
    chunk_frame_interval_seconds: int = 30
    frame_max_side: int = 768
    intro_skip_seconds: float = 3.0
    model: str = "gemini-3-flash-preview"
    enable_full_fixed_glossary: bool = False
    enable_srt_refine: bool = False
    enable_glossary_check: bool = False
    enable_cover_generation: bool = False

    @classmethod
    def read(cls, given: Mapping[str, str], prefix: str = "CUEWRIGHT_") -> Settings:
        """Those of the given values whose names, whatever their case, are settings after the prefix; others are ignored.

        A value that isn't of its setting's kind raises ValueError.
        """
        kinds, found = {f.name: type(f.default) for f in fields(cls)}, {}
        for key, raw in given.items():
            name = key.lower().removeprefix(prefix.lower())
            if not key.lower().startswith(prefix.lower()) or name not in kinds:
                continue
            value = raw.strip()
            if kinds[name] is bool:
                if value.lower() not in _TRUE | _FALSE:
                    raise ValueError(f"{key} is neither true nor false: {raw!r}")
                found[name] = value.lower() in _TRUE
            else:
                found[name] = kinds[name](value)
        return cls(**found)

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Those that the session has as cuewright.<name>."""
        return cls.read({f"cuewright.{f.name}": v for f in fields(cls) if (v := spark.conf.get(f"cuewright.{f.name}", None)) is not None}, "cuewright.")

    def stages_without(self) -> list[str]:
        """The optional stages that are off."""
        optional = {"refined": self.enable_srt_refine, "glossary_checked": self.enable_glossary_check, "cover_generated": self.enable_cover_generation}
        return [stage for stage, on in optional.items() if not on]


def lines_of(text: str) -> dict[str, str]:
    """NAME=value lines; blank ones and those that begin with # are skipped, quotes round a value go."""

    def parts(lines: Iterable[str]):
        for line in lines:
            name, sep, value = line.strip().removeprefix("export ").partition("=")
            if sep and not name.startswith("#"):
                value = value.strip()
                yield name.strip(), value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value

    return dict(parts(text.splitlines()))
