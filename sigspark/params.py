"""Parameters of the analysis, with the defaults that recordings are tuned from."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class General:
    waveform_len: int = 81

    def __post_init__(self) -> None:
        if self.waveform_len % 2 == 0:
            raise ValueError("waveform_len must be odd")


@dataclass(frozen=True)
class Filtering:
    freq: tuple[float, ...] = (100.0, 5000.0)
    order: int = 50
    pad: int = 5000


@dataclass(frozen=True)
class Whitening:
    noise_threshold: float = 0.15
    min_zone_len: int | None = None  # none: half a waveform
    num_acf_lags: int = 120
    reg: float = 0.0


@dataclass(frozen=True)
class Clustering:
    num_waveforms: int = 3
    spike_threshold: float = 6.0
    percent_variance: float = 90.0
    upsample: int = 5
    smooth_len: int = 5
    restarts: int = 25
    max_iter: int = 1000


@dataclass(frozen=True)
class Partition:
    threshold_stds: float = 4.0
    min_silence: int = 40
    min_snippet: int = 81
    max_snippet: int = 1001
    smooth_len: int = 1
    pad: int = 5


@dataclass(frozen=True)
class Inference:
    firing_rate: float = 1e-3
    accuracy: float = 0.1  # percent
    lam: float = 1.5
    reweight: float = 1.5
    magnitude_threshold: float = 1e-2
    greedy_p: float = 1 - 1e-5
    prefilter: float = 0.0
    noise_sigma: float = 1.0
    max_reweights: int = 1000


@dataclass(frozen=True)
class Learning:
    iterations: int = 200
    batch: int = 125
    step: float = 0.05


@dataclass(frozen=True)
class Amplitude:
    kde_points: int = 32
    kde_range: tuple[float, float] = (0.3, 1.0)
    peak_width: int = 5


@dataclass(frozen=True)
class Params:
    general: General = field(default_factory=General)
    filtering: Filtering = field(default_factory=Filtering)
    whitening: Whitening = field(default_factory=Whitening)
    clustering: Clustering = field(default_factory=Clustering)
    partition: Partition = field(default_factory=Partition)
    inference: Inference = field(default_factory=Inference)
    learning: Learning = field(default_factory=Learning)
    amplitude: Amplitude = field(default_factory=Amplitude)
    match_slack: int = 30
