"""The logical plan: which column is redacted how, and the edits a user makes to it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .lexicon import MODE_FOR_TYPE, MODES

SUGGEST_THRESHOLD = 0.5
LOW_CARDINALITY = 20
PREVIEW_ROWS = 60


@dataclass(frozen=True)
class RedactOptions:
    blank_with: str | None = None  # None: the empty string
    keep_start: int | None = None  # None: 1
    keep_end: int | None = None  # None: 0
    mask_char: str | None = None  # None or empty: *
    hash_style: str = "sha256"  # or sequential
    hash_length: int | None = None  # None: 12; from 4 to 64
    alias_prefix: str | None = None  # None or empty: ID
    salt: str | None = None  # None or empty: the run's
    locale: str | None = None  # None or empty: id
    consistent: bool = True
    keep_magnitude: bool = False  # fake amounts keep the size of their original
    force_invalid_luhn: bool = False  # fake card numbers never pass the checksum

    @property
    def mark(self) -> str:
        return self.mask_char or "*"

    @property
    def digest_length(self) -> int:
        return min(64, max(4, 12 if self.hash_length is None else self.hash_length))


@dataclass(frozen=True)
class ColumnPlan:
    index: int
    header: str
    semantic: str = "unknown"
    mode: str | None = None  # None: the column stays as it is
    options: RedactOptions = field(default_factory=RedactOptions)
    suggested: str | None = None
    score: float = 0.0
    low_cardinality: bool = False

    def __post_init__(self) -> None:
        if self.mode is not None and self.mode not in MODES:
            raise ValueError(f"{self.mode!r} is no mode; there are {', '.join(MODES)}; plans.registry adds others")


class RedactionPlan(tuple):
    """An immutable list of column plans."""

    @classmethod
    def from_profile(cls, profile: list) -> RedactionPlan:
        """Columns with a score of 0.5 or more start with their suggested mode, the others untouched."""
        return cls(
            ColumnPlan(p["index"], p["header"], p["semantic"], p["suggested_mode"] if p["score"] >= SUGGEST_THRESHOLD else None, RedactOptions(), p["suggested_mode"], p["score"], p["low_cardinality"]) for p in profile
        )

    def with_column(self, index: int, **changes) -> RedactionPlan:
        """The plan with changes (mode, semantic, options) to one column."""
        return type(self)(replace(p, **changes) if p.index == index else p for p in self)

    def with_mode(self, index: int, mode: str | None) -> RedactionPlan:
        return self.with_column(index, mode=mode)

    def select_all(self) -> RedactionPlan:
        return type(self)(replace(p, mode=p.suggested or MODE_FOR_TYPE.get(p.semantic, "hash")) for p in self)

    def clear(self) -> RedactionPlan:
        return type(self)(replace(p, mode=None) for p in self)

    def with_locale(self, locale: str) -> RedactionPlan:
        return type(self)(replace(p, options=replace(p.options, locale=locale)) for p in self)

    @property
    def active(self) -> list[ColumnPlan]:
        return [p for p in self if p.mode]

    def warnings(self, untouched_sheets: list[str] = ()) -> list[str]:
        """What a user should know before running the plan."""
        out = [f"{p.header}: fewer than {LOW_CARDINALITY} distinct values, so frequencies give hashes away" for p in self if p.mode == "hash" and p.low_cardinality]
        return out + [f"{s}: passes through unredacted" for s in untouched_sheets]


@dataclass(frozen=True)
class SheetJob:
    sheet: str
    header_row: int
    plans: RedactionPlan


def is_low_cardinality(distinct: int, rows: int) -> bool:
    return rows >= 2 * LOW_CARDINALITY and distinct < LOW_CARDINALITY


def confidence_band(score: float) -> str:
    return "high" if score >= 0.8 else "medium" if score >= 0.5 else "low"


def default_sheets(summary: list) -> list[str]:
    """The sheets selected at first: those with more than one row."""
    return [s["name"] for s in summary if s["row_count"] > 1]


def opening_step(summary: list, guesses: dict[str, int | None], auto: bool = True) -> tuple[str, str]:
    """(step, sheet) to begin with: with auto, choices that have one sensible answer are passed over, and stay open to change.

    guesses: sheet -> guessed header row, None where there is no guess.  One sheet with a guess begins at its columns, one without at its header, several at the
    choice of sheets, as all do without auto.  The sheet is the first with more than one row, or the first; empty where there is none."""
    first = next(iter([*default_sheets(summary), *(s["name"] for s in summary)]), "")
    if not auto or len(summary) != 1:
        return "sheets", first
    return ("columns" if guesses.get(first) is not None else "header"), first


def build_jobs(selected: dict[str, tuple[int, RedactionPlan]], locale: str = "id") -> list[SheetJob]:
    """sheet -> (header row, plan), as jobs with the locale in every plan."""
    return [SheetJob(sheet, header, plans.with_locale(locale)) for sheet, (header, plans) in selected.items()]
