"""Parameters of the library, with the published default values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Spread bins (name, lower bound, upper bound), half-open [lo, hi).
DEFAULT_BINS = (
    ("muy_barata", -999999.0, 0.0),
    ("barata", 0.0, 200.0),
    ("neutral", 200.0, 400.0),
    ("cara", 400.0, 600.0),
    ("escasez", 600.0, 999999.0),
)

# Archetype labels, in the order in which their rules are tried.
UNREGULATED = "Trader no regulado"
OVERCONTRACTED = "Trader con sobrecobertura de contratos"
SPOT_EXPOSED = "Trader expuesto a bolsa (sin cobertura)"
INTEGRATED_REGULATED = "Integrado/regional regulado"
REGULATED = "Comercializador regulado"
MIXED_NETWORK = "Comercializador mixto con red"
MIXED_AUCTION = "Comercializador mixto con convocatoria"
MIXED = "Comercializador mixto"
ARCHETYPES = (
    UNREGULATED,
    OVERCONTRACTED,
    SPOT_EXPOSED,
    INTEGRATED_REGULATED,
    REGULATED,
    MIXED_NETWORK,
    MIXED_AUCTION,
    MIXED,
)

# Fixed value: Euler-Mascheroni constant, used by the deflated Sharpe ratio.
EULER_GAMMA = 0.5772156649015329


@dataclass(frozen=True)
class MarginModel:
    """Constants of the modelled margin per unit of demand."""

    sale_price: float = 350.0
    charge: float = 76.1
    cover_factor: float = 0.25
    annual_rate: float = 0.02
    bad_debt: float = 0.02
    tax: float = 0.33
    margin_clip: float | None = 500.0
    auction_clip: float = 100.0


@dataclass(frozen=True)
class SizeRule:
    """Size thresholds on the window total, largest segment first.

    ``per_days`` states the window length the thresholds were written for; when
    it is given they are scaled to the length of each window, otherwise they
    apply to whatever window is summed.
    """

    large_min: float = 2000.0
    medium_min: float = 100.0
    labels: tuple[str, str, str] = ("LARGE", "MEDIUM", "SMALL")
    per_days: int | None = None


@dataclass(frozen=True)
class SpreadBins:
    """Contiguous spread bins; anything beyond the ends falls in the end bin."""

    bins: tuple[tuple[str, float, float], ...] = DEFAULT_BINS

    def __post_init__(self):
        ordered = tuple(sorted(self.bins, key=lambda b: b[1]))
        if not ordered:
            raise ValueError("at least one spread bin is needed")
        names = [b[0] for b in ordered]
        if len(set(names)) != len(names):
            raise ValueError(f"spread bin names repeat: {names}")
        for name, lo, hi in ordered:
            if not lo < hi:
                raise ValueError(f"spread bin {name!r} is empty: [{lo}, {hi})")
        object.__setattr__(self, "bins", ordered)

    @property
    def names(self) -> list[str]:
        return [b[0] for b in self.bins]


@dataclass(frozen=True)
class Selection:
    """How leaders are picked and tested."""

    top: int = 10
    min_presence_pct: float = 20.0
    relative: bool = True
    duplicate_corr: float = 0.9
    seed: int = 42
    draws: str = "class"  # or "md5", which plain SQL can repeat

    @property
    def value(self) -> str:
        """The column that leaders are compared and tested by."""
        return "rel" if self.relative else "margin"


@dataclass(frozen=True)
class PolicyRules:
    """How a policy is applied and judged on later days."""

    use_previous_spot: bool = True
    outside_exposure_factor: float = 0.5
    weighted: bool = False
    weight_eta: float = 1.0
    capacity_max_pct: float = 5.0
    kill_drawdown: float = 500.0
    dry_year_pct: float = 25.0


@dataclass(frozen=True)
class Gates:
    """Thresholds of the nine pass/fail gates."""

    alpha: float = 0.05
    min_n_effective: int = 3
    min_persistence: float = 50.0
    min_replication: float = 0.5
    min_dsr: float = 0.95
    min_pct_beats_segment: float = 60.0
    min_expected_value: float = 0.0


@dataclass(frozen=True)
class Scan:
    """Replicate counts and limits of the coarse and the fine search."""

    boot_coarse: int = 200
    boot_fine: int = 1000
    holdout_days: int = 2
    max_confirm: int = 25
    near_confirm: int = 8
    sweep_limit: int = 20


@dataclass(frozen=True)
class Settings:
    """One bundle for the composed plans."""

    model: MarginModel = field(default_factory=MarginModel)
    sizes: SizeRule = field(default_factory=SizeRule)
    bins: SpreadBins = field(default_factory=SpreadBins)
    selection: Selection = field(default_factory=Selection)
    policy: PolicyRules = field(default_factory=PolicyRules)
    gates: Gates = field(default_factory=Gates)
    scan: Scan = field(default_factory=Scan)
    activities: tuple[str, ...] | None = None
