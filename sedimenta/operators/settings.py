"""Settings of codec, store and journal: defaults, named profiles, and which of them wins."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codec:
    chunk_size: int = 512 * 1024
    block_size: int = 64
    ranks: bool = True
    transform: str = "none"
    seed: int = 1337
    entropy_skip: float = 7.5

    def __post_init__(self) -> None:
        if not 0 < self.block_size <= self.chunk_size:
            raise ValueError("a block is no larger than a chunk, and not empty")


@dataclass(frozen=True)
class Journal:
    sync_every: int = 0
    compress: bool = False
    min_size: int = 4096
    min_gain: int = 128
    inline_max: int = 4 << 20
    extent_size: int = 4 << 20


# What the named profiles set.
PROFILES = {
    None: {},
    "business": {"sync_every": 64, "compress": True, "extent_size": 8 << 20},
    "media": {"sync_every": 16, "min_size": 65536, "min_gain": 1024, "extent_size": 16 << 20},
}


def journal_settings(profile: str | None = None, compress_off: bool = False, **given) -> Journal:
    """A profile with what is given beside it; a value given wins over the profile's, and compress_off over both. An unknown
    profile changes nothing."""
    out = replace(Journal(), **(PROFILES.get(profile, {}) | {k: v for k, v in given.items() if v is not None}))
    return replace(out, compress=False) if compress_off else out


def inherited(base: dict, **given) -> Codec:
    """The settings in a container's superblock, where nothing is given that replaces them."""
    known = {f.name for f in fields(Codec)}
    return replace(Codec(), **({k: v for k, v in base.items() if k in known} | {k: v for k, v in given.items() if v is not None}))


def integers(text: Column) -> Column:
    """A list of whole numbers between commas; empty parts are passed over."""
    return F.transform(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("int"))


def octal(text: Column) -> Column:
    return F.conv(F.regexp_replace(text, "^0o", ""), 8, 10).cast("int")


def clamped(x: Column, low: float = 0.0, high: float = 1.0, missing: float = 0.5) -> Column:
    """x between its bounds; what is no number becomes `missing`."""
    return F.when(x.isNull() | F.isnan(x), F.lit(missing)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def video_bitrate(size_bytes: Column, seconds: Column, audio_bits: int = 128_000) -> Column:
    """Bits a second left for video where a clip must fit a size; 0 where audio alone is too much."""
    return F.greatest(F.lit(0), F.floor(size_bytes * 8 / F.nullif(seconds, F.lit(0)) - audio_bits)).cast("bigint")
