"""Settings of the engine. Everything that a city, a season or a policy may change is here, none of it in the operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class City:
    """What tells one city's transactions from the others'. Names, prefixes, patterns and letters are those of the data."""

    country: str = "POLAND"
    postal_prefixes: tuple[str, ...] = ("90", "91", "92", "93", "94")
    folded_name: str = "LODZ"
    meter_pattern: str = r"^SPP LODZ\s+(\d+[A-Z]?)"
    resident_area: str | None = "LODZ"
    foreign_parking: str | None = None
    time_zone: str = "Europe/Warsaw"
    #: Letters at the end of a meter's id, and the subzone of today's division that each stands for.
    subzones: dict[str, str] = field(default_factory=lambda: {"A": "A", "B": "B", "C": "B", "D": "C"})
    #: Letters that name a subzone of the earlier division.
    earlier_subzones: tuple[str, ...] = ("A", "B", "C", "D")


LODZ = City()
KRAKOW = City(postal_prefixes=("30", "31"), folded_name="KRAKOW", meter_pattern=r"^PARKOMAT\s+0*(\d+)$", resident_area=None, foreign_parking=r"WROCLAW|BIALYSTOK|^KBU\b|UNICARD")


@dataclass(frozen=True)
class Block:
    name: str
    start: int
    end: int


@dataclass(frozen=True)
class Period:
    name: str
    first: str
    last: str
    season: bool = True


#: Fixed value: the factor in the amounts of the card data that the engine is made for.
SCALED_AMOUNTS = 0.92


@dataclass(frozen=True)
class Settings:
    city: City = LODZ
    min_cards: int = 30
    hub_merchants: int = 400
    #: Amounts are divided by this: 1 where they are as paid, SCALED_AMOUNTS where their owner has scaled them.
    amount_scale: float = 1.0
    gap_minutes: int = 90
    payment_minutes: int = 180
    regular_days: int = 3
    regular_minutes: int = 240
    # Codes, names and bounds of the data and of the policy, from here to the levels.
    parking_mcc: int = 7523
    excluded_mcc: tuple[int, ...] = (7523, 4111, 4784)
    fuel_mcc: tuple[int, ...] = (5541, 5542)
    visit_types: tuple[str, ...] = ("POS", "ATM")
    manual_modes: tuple[str, ...] = ("Manual key entry", "COF")
    remote_channels: tuple[str, ...] = ("eci", "recur", "moto")
    blocks: tuple[Block, ...] = (Block("07-10", 7, 10), Block("10-13", 10, 13), Block("13-16", 13, 16), Block("16-19", 16, 19))
    periods: tuple[Period, ...] = (
        Period("before_reform", "2025-01-01", "2025-05-31", False),
        Period("summer", "2025-06-01", "2025-09-30"),
        Period("academic", "2025-10-01", "2026-06-30"),
    )
    # Weekdays without fees.
    holidays: tuple[str, ...] = (
        "2025-01-01", "2025-01-06", "2025-04-21", "2025-05-01", "2025-06-19", "2025-08-15", "2025-11-11", "2025-12-24", "2025-12-25", "2025-12-26",
        "2026-01-01", "2026-01-06", "2026-04-06", "2026-05-01", "2026-06-04",
    )
    #: Names of merchants that are no destination of a visit.
    exclusions: tuple[str, ...] = ()
    #: Pressure above these is level P2, P3, P4.
    cuts: tuple[float, float, float] = (0.05, 0.15, 0.30)

    @property
    def seasons(self) -> list[str]:
        return [p.name for p in self.periods if p.season]


@dataclass(frozen=True)
class Level:
    """A level's rates as multiples of the base rate: a preferential period (a flat fee, or by the hour), then up to the
    step, then beyond it."""

    name: str
    free_minutes: int
    first: float
    flat: bool
    then: float
    after: float


@dataclass(frozen=True)
class Policy:
    base_rate: float = 6.0
    resident_share: float = 0.85
    step_minutes: int = 120
    longest_first: int = 60
    levels: tuple[Level, ...] = (Level("P1", 60, 0.6, False, 0.8, 0.8), Level("P2", 60, 1.0, False, 1.2, 1.4), Level("P3", 45, 0.5, True, 1.5, 2.0), Level("P4", 30, 0.3, True, 2.0, 3.0))
    #: Minutes by which a dominant service group moves the end of the preferential period.
    shifts: dict[str, int] = field(default_factory=lambda: {"quick_services": -15, "personal_services": 15, "leisure": 15})


#: How seasons, blocks and service groups are shown.
SEASON_LABELS = {"summer": "Summer (June to September 2025)", "academic": "Academic year (October 2025 to June 2026)"}
BLOCK_LABELS = {"07-10": "7 to 10", "10-13": "10 to 13", "13-16": "13 to 16", "16-19": "16 to 19"}
GROUP_LABELS = {"quick_services": "Quick services", "small_grocery": "Small groceries", "retail": "Retail", "food_service": "Food service", "personal_services": "Personal services", "leisure": "Leisure and culture"}
AREA_LABELS = {"true": "paid zone", "false": "buffer"}
