"""An open registry of detectors and modes: what is added here at run time is voted on by profiles, planned and redacted like the built-in ones.

    register_detector("plate", lambda text: text.rlike(r"^[A-Z]{1,2} [0-9]{1,4} [A-Z]{1,3}\\z"), before="name", headers=["plat nomor", "plate"], mode="tail")
    register_mode("tail", lambda text, plan, salt: F.concat(F.lit("..."), F.right(text, F.lit(3))))

A detector should be strict: what also fits other data belongs behind requires_header.  The registry is the driver's, read as expressions are built; executors see only the expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column

from ..functions.validators import VALUE_TESTS
from .lexicon import HEADER_LEXICON, MODE_FOR_TYPE, MODES, SEMANTIC_TYPES

#: mode -> builder of the redacted text from (text, column plan, the run's salt).
OWN_MODES: dict[str, Callable] = {}


def detectors() -> list[str]:
    """The types that values are tested for, in the order that settles ties."""
    return [kind for kind, _, _ in VALUE_TESTS]


def register_detector(name: str, test: Callable[[Column], Column], before: str | None = None, requires_header: bool = False, headers: Sequence[str] = (), mode: str = "hash") -> None:
    """Adds a type of value: test is a predicate over a cell's text (functions.sql.sql_predicate makes one from SQL text), placed before another type (at the end if none is named); headers
    are the keywords of its header, which win over those of later types, and mode is what plans suggest for it.  A column is of the type if 70 % of its sampled cells pass and, with requires_header, its header says so too."""
    if name in SEMANTIC_TYPES or name in detectors():
        raise ValueError(f"there is a type {name!r} already")
    if mode not in MODES:
        raise ValueError(f"{mode!r} is no mode; there are {', '.join(MODES)}")
    at = detectors().index(before) if before else len(VALUE_TESTS)
    VALUE_TESTS.insert(at, (name, lambda cell, text, dtype: test(text), requires_header))
    if headers:
        kinds = [kind for kind, _ in HEADER_LEXICON]
        HEADER_LEXICON.insert(kinds.index(before) if before in kinds else len(kinds), (name, [h.lower() for h in headers]))
    MODE_FOR_TYPE[name] = mode


def register_mode(name: str, build: Callable) -> None:
    """Adds a way to redact: build(text, plan, salt) gives the redacted text of a cell that is not empty; plan is the column's, with its options."""
    if name in MODES:
        raise ValueError(f"there is a mode {name!r} already")
    MODES.append(name)
    OWN_MODES[name] = build


def unregister(name: str) -> None:
    """Takes a registered type or mode of this name back; built-in ones stay."""
    if name in OWN_MODES:
        del OWN_MODES[name]
        MODES.remove(name)
    if name not in SEMANTIC_TYPES:
        VALUE_TESTS[:] = [t for t in VALUE_TESTS if t[0] != name]
        HEADER_LEXICON[:] = [x for x in HEADER_LEXICON if x[0] != name]
        MODE_FOR_TYPE.pop(name, None)


@contextmanager
def registered(name: str, *args, **options) -> Iterator[None]:
    """A detector that is there while the block runs; profiles and plans made in it can be used afterwards."""
    register_detector(name, *args, **options)
    try:
        yield
    finally:
        unregister(name)
