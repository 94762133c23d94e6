"""Options of the operators: one table of defaults, read by name.

A stage's options are a plain record of named values.  ``options("dip",
points=8)`` gives the defaults of a stage with some of them changed; names that
the stage does not have are an error.  ``Settings`` holds the options of all
stages of the pipeline.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from dataclasses import dataclass

# --- fixed values: defaults that results depend on; "" is an unset value ------
DEFAULTS = tomllib.loads("""
[merge]        # nearest record in time, widened channel by channel
tolerance_days = 2.3148148148148147e-05
channel_mhz = 1.0          # unset: channels are not looked at
by_channel = false

[covariates]
phase = true
elongation = true
elevation = false
airmass = false
parallactic = false
freq_bins = 0              # 0: none
site_table = ""

[structure]    # chi-squared of binned means over covariates
mode = "none"              # none, test, detrend or both
detrend = ["solar_elongation_deg", "orbital_phase"]
test = ["solar_elongation_deg", "orbital_phase"]
circular = ["orbital_phase"]
bins = 12
per_bin = 3
level = 0.01
by = ""

[preproc]      # detrending and rescaling before some detectors
detrend = []
rescale = ""
circular = ["orbital_phase"]
bins = 12
per_bin = 5
within = ["grp"]
used_by = []

[noise]        # correlated noise and bad days
tau_days = 0.02
fdr = 0.01
worst_only = true

[robust]
on = true
z = 5.0
scope = "global"           # backend, global or both

[gate]
on = false
sigmas = 3.0
value = ""
error = ""

[orbital]
on = false
centre = 0.25
limit = ""
sigmas = 3.0
bins = 18
points = 20

[step]
on = true
scope = "both"
points = 20
gain = 25.0                # least fall of chi-squared
span_days = ""
horizon_days = 3650.0
eta = 1.0                  # least size of a member in its own sigma

[dm_step]
on = true
scope = "both"
points = 20
gain = 25.0
span_days = ""
horizon_days = 3650.0
eta = 1.0

[transient]
scope = "backend"
decay_days = 7.0
reach = 5.0                # window in decay times
points = 6
gain = 25.0
exclusive = true           # no two events share rows
eta = 1.0

[dip]
scope = "global"
decay_days = 30.0
reach = 5.0
points = 6
gain = 25.0
exclusive = true
eta = 1.0
least_days = 21.0
colour = true              # size falls with a fitted power of frequency
colour_range = [2.0, 4.0]
colour_tol = 1e-3
colour_rounds = 64

[bump]
on = false
lengths = [60.0, 1500.0]
n_lengths = 6
points = 20
gain = 25.0
exclusive = true
eta = 1.0
colour = true
colour_range = [0.0, 4.0]
colour_tol = 1e-3
colour_rounds = 64

[glitch]
on = false
points = 30
gain = 25.0
exclusive = true
eta = 1.0
decay_days = 30.0
noise = 1.0                # least height of a start above the rows after it, in their scatter
mean_days = 180.0
least_days = 1000.0

[solar]
on = false
scale_range = [2.0, 60.0]
near_deg = 30.0
points = 30
points_year = 10
points_near = 3
eta = 1.0
colour = true
colour_range = [0.0, 4.0]

[eclipse]
on = false
centre = 0.25
scale_range = [0.01, 0.5]
points = 30
eta = 1.0
colour = true
colour_range = [0.0, 4.0]
""")
# -----------------------------------------------------------------------------


def _value(v):
    """Lists are tuples here, and an unset value is None."""
    return tuple(v) if isinstance(v, list) else None if v == "" else v


@dataclass(frozen=True)
class Options:
    """The options of one stage, read as attributes."""

    stage: str
    items: tuple[tuple[str, object], ...]

    def __getattr__(self, name: str):
        if name.startswith("_") or name in ("stage", "items"):
            raise AttributeError(name)
        for k, v in self.items:
            if k == name:
                return v
        raise AttributeError(f"{self.stage} has no option {name}")

    def but(self, **changes) -> Options:
        known = dict(self.items)
        if unknown := sorted(set(changes) - set(known)):
            raise TypeError(f"{self.stage} has no option {', '.join(unknown)}")
        return Options(self.stage, tuple({**known, **{k: _value(v) for k, v in changes.items()}}.items()))


def options(stage: str, **changes) -> Options:
    """The defaults of ``stage`` with ``changes``."""
    return Options(stage, tuple((k, _value(v)) for k, v in DEFAULTS[stage].items())).but(**changes)


class Settings:
    """Options of every stage, and what to do with rows without a record.

    Stages are given as ``options`` or as mappings of changes; the others have
    their defaults.
    """

    def __init__(self, *, drop_unmatched: bool = False, **stages):
        if unknown := sorted(set(stages) - set(DEFAULTS)):
            raise TypeError(f"no stage {', '.join(unknown)}")
        given = {k: v if isinstance(v, Options) else options(k, **v) for k, v in stages.items()}
        if wrong := sorted(k for k, v in given.items() if v.stage != k and {k, v.stage} != {"step", "dm_step"}):
            raise TypeError(f"options of another stage for {', '.join(wrong)}")
        self.drop_unmatched = drop_unmatched
        self.stages = {k: given[k] if k in given else options(k) for k in DEFAULTS}

    def __getattr__(self, name: str) -> Options:
        if name.startswith("_") or name == "stages":
            raise AttributeError(name)
        if name in self.stages:
            return self.stages[name]
        raise AttributeError(name)

    def __iter__(self) -> Iterator[Options]:
        return iter(self.stages.values())

    def __eq__(self, other) -> bool:
        return isinstance(other, Settings) and (self.drop_unmatched, self.stages) == (other.drop_unmatched, other.stages)

    __hash__ = None

    def but(self, *, drop_unmatched: bool | None = None, **stages) -> Settings:
        """These settings with some stages changed, each by options or by a mapping of changes."""
        made = {k: self.stages[k].but(**v) if isinstance(v, dict) else v for k, v in stages.items()}
        return Settings(drop_unmatched=self.drop_unmatched if drop_unmatched is None else drop_unmatched, **{**self.stages, **made})
