"""Settings of the processing jobs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import yaml


@dataclass(frozen=True)
class ProfileConfig:
    """All settings from samples to dissipation rates. Times are in seconds,
    frequencies in Hz, pressures in dbar, angles in degrees."""

    # The names and defaults of the settings below.

    # names of channels
    pressure: str = "P"
    speed: str = "W"
    temperature: str = "JAC_T"
    pitch: str = "Incl_Y"
    shear_probes: tuple[str, ...] = ("sh1", "sh2")
    temperature_probes: tuple[str, ...] = ("gradT1", "gradT2")
    accel_channels: tuple[str, ...] = ("Ax", "Ay", "Az")
    emc_channels: tuple[str, ...] = ("EMC_Cur", "EM_Cur")
    # windows and filters
    diss_len_sec: float = 4.0
    fft_len_sec: float = 1.0
    ctd_bin_sec: float = 0.25
    chop_start: bool = True
    pressure_smoothing_period: float = 0.5
    filter_order: int = 4
    gap_threshold: float = 2.0
    gap_factor: float = 4.0
    hp_cutoff_hz: float = 0.0
    # speed
    use_pitch_correction: bool = False
    angle_of_attack: float = 3.0
    dbar_to_m: float = 1.005
    # detection of profiles
    profile_direction: str = "down"
    min_profile_pressure: float = 0.0
    peaks_kwargs: dict = field(default_factory=lambda: {"height": 25, "distance": 200, "width": 200, "prominence": 25})
    # despiking and coherent noise
    despike_max_passes: int = 6
    despike_thresh: float = 8.0
    despike_smooth: float = 0.5
    despike_replace_sec: float = 0.04
    force_despike: bool = False
    accel_clean: bool = False
    emc_clean: bool = True
    # quality
    min_speed: float = 0.2
    fm_good: float = 1.5
    fm_bad: float = 2.5
    despike_frac_questionable: float = 0.1
    despike_frac_bad: float = 0.2
    # hydrography
    default_temperature: float = 10.0
    default_salinity: float = 35.0
    default_density: float = 1025.0
    default_latitude: float = 45.0
    default_longitude: float = 0.0
    compute_thermo: bool = False
    match_conductivity: bool = True
    jac_lag: float = 0.0234
    jac_f_tc: float = 0.73
    jac_reference_speed: float = 0.62
    stationary_platform: bool | None = None
    # auxiliary series
    aux_time: str = "time"
    aux_latitude: str = "lat"
    aux_longitude: str = "lon"
    aux_temperature: str | None = None
    aux_salinity: str | None = None
    aux_density: str | None = None

    def __post_init__(self) -> None:
        if self.profile_direction not in ("down", "up", "both"):
            raise ValueError(f"unknown direction {self.profile_direction!r}")

    @property
    def all_probes(self) -> tuple[str, ...]:
        return (*self.shear_probes, *self.temperature_probes)

    @property
    def speed_smooth(self) -> str:
        return f"{self.speed}_smooth"

    @property
    def pressure_smooth(self) -> str:
        return f"{self.pressure}_smooth"

    @property
    def shear_cutoff(self) -> float | None:
        """High-pass cutoff of shear: as set, by the FFT length if 0, none below."""
        return self.hp_cutoff_hz if self.hp_cutoff_hz > 0 else 0.5 / self.fft_len_sec if self.hp_cutoff_hz == 0 else None

    def to_yaml(self) -> str:
        plain = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}
        return yaml.safe_dump(plain, sort_keys=False, default_flow_style=False)
