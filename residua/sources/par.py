"""Parameter files: one reader for all keys."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from residua.functions.geometry import to_equatorial


@dataclass(frozen=True)
class ParFile:
    """Upper-cased key to its first value token; the last line of a key holds."""

    values: dict[str, str]

    def text(self, *keys: str) -> str | None:
        return next((self.values[k] for k in keys if k in self.values), None)

    def number(self, *keys: str) -> float | None:
        return to_number(self.text(*keys))


def to_number(token: str | None) -> float | None:
    """A float with e or d exponent, else None."""
    try:
        return None if token is None else float(re.sub("[dD]", "e", token))
    except ValueError:
        return None


def read_par(path: str | Path) -> ParFile:
    values = {}
    for line in Path(path).read_text(errors="replace").splitlines():
        parts = line.split()
        if len(parts) >= 2 and not parts[0].startswith("#"):
            values[parts[0].upper()] = parts[1]
    return ParFile(values)


def angle(token: str | None, *, hours: bool) -> float | None:
    """Degrees of a sexagesimal or decimal angle; a sexagesimal one may count hours."""
    if token is None:
        return None
    if ":" not in token:
        return to_number(token)
    sign = -1.0 if token.strip().startswith("-") else 1.0
    parts = [to_number(p.lstrip("+-")) for p in token.split(":")]
    if any(p is None for p in parts):
        return None
    value = sign * sum(p / 60.0**i for i, p in enumerate(parts))
    return value * 15.0 if hours else value


def sky_position(par: ParFile) -> tuple[float, float] | None:
    """(ra, dec) in degrees from equatorial, ecliptic or galactic keys, in that order."""
    for kind, lon_keys, lat_keys in (("equatorial", ("RAJ", "RA"), ("DECJ", "DEC")), ("ecliptic", ("ELONG", "LAMBDA"), ("ELAT", "BETA")), ("galactic", ("GLONG", "GL"), ("GLAT", "GB"))):
        lon, lat = angle(par.text(*lon_keys), hours=kind == "equatorial"), angle(par.text(*lat_keys), hours=False)
        if lon is not None and lat is not None:
            return to_equatorial(kind, lon, lat)
    return None


def discover_all_tim(parfile: str | Path) -> Path:
    """X.par (in any case) -> X_all.tim; any other name -> name_all.tim."""
    p = Path(parfile)
    stem = p.name[:-4] if p.name.lower().endswith(".par") else p.name
    return p.with_name(f"{stem}_all.tim")
