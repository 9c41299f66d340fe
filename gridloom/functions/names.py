"""Names of options and surfaces, which may be shortened as long as they stay unambiguous."""

from __future__ import annotations


def match_option(text: str, options: list[str]) -> str:
    """The option that begins with ``text``, whatever the case; an exact match goes first."""
    low = text.lower()
    exact = [o for o in options if o.lower() == low]
    found = exact or [o for o in options if o.lower().startswith(low)]
    if len(found) != 1:
        raise ValueError(f"{text!r} {'is ambiguous among' if found else 'is none of'} {', '.join(found or options)}")
    return found[0]
