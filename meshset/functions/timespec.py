"""Time specifications: dates, times of day, weekdays and distances from now, in any order."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

from meshset.errors import InvalidTimespec

UNITS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 604800, "fortnight": 1209600}
DAYS = {"now": 0, "today": 0, "yesterday": -1, "tomorrow": 1}
WEEK = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
YEAR = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _any(names: list[str]) -> str:
    """A pattern for whole names and their first three letters."""
    return "|".join(f"{n[:3]}(?:{n[3:]})?" for n in names)


#: What a specification consists of; the first one that fits is taken, again and again.
ITEMS = [
    (kind, re.compile(pattern + r"(?![a-z0-9])"))
    for kind, pattern in (
        ("date", r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})t?"), ("date", r"(?P<m>\d{1,2})/(?P<d>\d{1,2})(?:/(?P<y>\d{4}))?"),
        ("date", rf"(?P<d>\d{{1,2}})\s+(?P<name>{_any(YEAR)})\.?(?:,?\s+(?P<y>\d{{4}}))?"), ("date", rf"(?P<name>{_any(YEAR)})\.?\s+(?P<d>\d{{1,2}})(?:,?\s+(?P<y>\d{{4}}))?"),
        ("time", r"(?P<h>\d{1,2}):(?P<min>\d{2})(?::(?P<s>\d{2})(?:\.\d+)?)?\s*(?P<half>am|pm)?"), ("time", r"(?P<h>\d{1,2})\s*(?P<half>am|pm)"), ("time", r"(?P<word>noon|midnight)"),
        ("weekday", rf"(?:(?P<which>last|next|this)\s+)?(?P<name>{_any(WEEK)}),?"), ("word", "(?P<word>now|today|yesterday|tomorrow)"), ("zone", r"(?:utc|gmt|z)"), ("zone", r"(?P<sign>[+-])(?P<h>\d{2}):?(?P<min>\d{2})"),
        ("distance", r"(?:(?P<which>last|next|this)\s+|(?P<sign>[+-])?\s*(?P<n>\d+)?\s*)(?P<unit>second|sec|minute|min|hour|day|week|fortnight|month|year)s?(?P<ago>\s+ago)?"),
    )
]


def _months_later(at: datetime, n: int) -> datetime:
    """The same day of another month, running over into the next where the month is shorter."""
    months = at.year * 12 + at.month - 1 + n
    return at.replace(year=months // 12, month=months % 12 + 1, day=1) + timedelta(days=at.day - 1)


def parse(text: str, now: datetime | None = None) -> datetime:
    """A UTC time from ISO or RFC 2822 text, ``@seconds``, or items such as "yesterday 14:30", "next friday", "5 March" and "now - 5 days".

    A date or weekday without a time of day is its midnight; distances add to
    the rest.  A weekday is the next one, today included; with "next" not today,
    with "last" the one before today.
    """
    now = now or datetime.now(UTC)
    now = now if now.tzinfo else now.replace(tzinfo=UTC)
    said = text.strip()
    if re.fullmatch(r"@-?\d+", said):
        return datetime.fromtimestamp(int(said[1:]), UTC)
    for read in (datetime.fromisoformat, parsedate_to_datetime):
        try:
            got = read(said)
            return got.astimezone(UTC) if got.tzinfo else got.replace(tzinfo=UTC)
        except (ValueError, TypeError):
            pass
    try:
        return _items(said.lower(), text, now)
    except (ValueError, OverflowError) as e:
        raise InvalidTimespec(text) from e


def _items(rest: str, text: str, now: datetime) -> datetime:
    at, clock, months, span, weekday, zone = now, None, 0, timedelta(), None, UTC
    dated = found = False
    while rest:
        kind, m = next(((k, m) for k, p in ITEMS if (m := p.match(rest))), (None, None))
        if m is None or not m[0]:
            raise InvalidTimespec(text)
        g, found = m.groupdict(), True
        rest = rest[m.end() :].strip(" ,")
        if kind == "date":
            month = int(g["m"]) if g.get("m") else [n[:3] for n in YEAR].index(g["name"][:3]) + 1
            at, dated = at.replace(year=int(g["y"] or at.year), month=month, day=int(g["d"])), True
        elif kind == "time":
            clock = _clock(g)
        elif kind == "weekday":
            weekday, dated = ([n[:3] for n in WEEK].index(g["name"][:3]), g["which"]), True
        elif kind == "word":
            span += timedelta(days=DAYS[g["word"]])
        elif kind == "zone":
            zone = timezone((-1 if g.get("sign") == "-" else 1) * timedelta(hours=int(g.get("h") or 0), minutes=int(g.get("min") or 0)))
        else:
            n = {"last": -1, "next": 1, "this": 0}[g["which"]] if g["which"] else int(g["n"] or 1)
            n *= -1 if (g["sign"] == "-") != bool(g["ago"]) else 1
            if g["unit"] in UNITS:
                span += timedelta(seconds=n * UNITS[g["unit"]])
            else:
                months += n * (12 if g["unit"] == "year" else 1)
    if not found:
        raise InvalidTimespec(text)
    if weekday:
        ahead = (weekday[0] - at.weekday()) % 7
        at += timedelta(days=ahead - 7 if weekday[1] == "last" else 7 if weekday[1] == "next" and not ahead else ahead)
    if clock or dated:
        h, minute, s = clock or (0, 0, 0)
        at = at.replace(hour=h, minute=minute, second=s, microsecond=0, tzinfo=zone)
    return (_months_later(at, months) + span).astimezone(UTC)


def _clock(g: dict) -> tuple[int, int, int]:
    if g.get("word"):
        return (12 if g["word"] == "noon" else 0), 0, 0
    h = int(g["h"])
    if g.get("half"):
        if not 1 <= h <= 12:
            raise ValueError("no such hour")
        h = h % 12 + (12 if g["half"] == "pm" else 0)
    return h, int(g.get("min") or 0), int(g.get("s") or 0)
