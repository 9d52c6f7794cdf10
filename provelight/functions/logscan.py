"""Character-level scanner for log heads.

A line of a log either opens an entry, by a head that names a level and a
component, or continues the entry before it.  The scanner decides this and cuts
the head into fields with one deterministic state machine over character
classes and a handful of grammars over its tokens:

* ``TIME`` is a table-driven machine for time stamps, built from the layouts in
  ``TIME_LAYOUTS``; each state maps a character class to the next state.
* ``tokens`` is the machine for everything else: words, numbers, quoted strings
  with escapes, bracketed groups, terminal colour codes and single delimiters.
* a grammar is a sequence of token kinds with the field each one fills.

Only heads are scanned; the rest of a line is skipped to its line feed.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from functools import lru_cache

# Spellings of the five levels.
LEVELS = {
    "debug": "debug", "dbg": "debug", "trace": "debug", "d": "debug",
    "info": "info", "inf": "info", "information": "info", "notice": "info", "i": "info",
    "warning": "warning", "warn": "warning", "wrn": "warning", "w": "warning",
    "error": "error", "err": "error", "e": "error",
    "fatal": "fatal", "critical": "fatal", "crit": "fatal", "ftl": "fatal", "f": "fatal", "c": "fatal",
}
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
#: 9 digit, A letter, _ space or digit; other characters stand for themselves.
#: After a layout: optional fraction (. or ,) and optional zone (Z, +hh:mm, +hhmm, also after a space).
TIME_LAYOUTS = {
    "9999-99-99T99:99:99": "ymdHMS",
    "9999-99-99 99:99:99": "ymdHMS",
    "9999/99/99 99:99:99": "ymdHMS",
    "99/AAA/9999:99:99:99": "dbyHMS",
    "AAA _9 99:99:99": "bdHMS",
    "A9999 99:99:99": "LMDHMS",
}


def _char_class(ch: str) -> str:
    if "0" <= ch <= "9":
        return "9"
    if ch.isalpha():
        return "A"
    return ch


def _build_time_machine() -> tuple[list[dict[str, int]], dict[int, str]]:
    states: list[dict[str, int]] = [{}]
    final: dict[int, str] = {}
    for layout in TIME_LAYOUTS:
        at = 0
        for ch in layout:
            for cls in (" ", "9") if ch == "_" else (ch,):
                if cls not in states[at]:
                    states.append({})
                    states[at][cls] = len(states) - 1
            step = states[at]["9" if ch == "_" else ch]
            if ch == "_":  # both readings lead to one state
                states[at][" "] = step
            at = step
        final[at] = layout
    return states, final


TIME, TIME_FINAL = _build_time_machine()


def scan_time(line: str, at: int = 0) -> tuple[int, str, int, str, str] | None:
    """(end, layout, end of layout, fraction, zone) of the longest time stamp at ``at``."""
    state, pos, n, hit = 0, at, len(line), None
    while pos < n:
        ch = line[pos]
        step = TIME[state]
        state = step.get(ch, -1)
        if state < 0:
            state = step.get(_char_class(ch), -1)
        if state < 0:
            break
        pos += 1
        if state in TIME_FINAL:
            hit = (pos, TIME_FINAL[state])
    if hit is None:
        return None
    end, layout = hit
    body, fraction, zone = end, "", ""
    if end < n and line[end] in ".,":
        stop = end + 1
        while stop < n and "0" <= line[stop] <= "9":
            stop += 1
        if stop > end + 1:
            fraction, end = line[end + 1 : stop], stop
    stop = end
    if stop < n and line[stop] == "Z":
        zone, end = "Z", stop + 1
    else:
        if stop + 1 < n and line[stop] == " " and line[stop + 1] in "+-":
            stop += 1
        if stop < n and line[stop] in "+-":
            digits, p = "", stop + 1
            while p < n and len(digits) < 4 and ("0" <= line[p] <= "9" or (line[p] == ":" and len(digits) == 2)):
                if line[p] != ":":
                    digits += line[p]
                p += 1
            if len(digits) == 4:
                zone, end = line[stop] + digits, p
    return end, layout, body, fraction, zone


@lru_cache(maxsize=65536)
def _seconds(layout: str, text: str, year: int) -> int | None:
    """Seconds since 1970 of a time stamp without fraction and zone."""
    y, mo, d, clock = year, 0, 0, ""
    try:
        if layout[0] == "9" and layout[4] in "-/":
            y, mo, d, clock = int(text[:4]), int(text[5:7]), int(text[8:10]), text[11:]
        elif layout.startswith("99/"):
            d, mo, y, clock = int(text[:2]), MONTHS[text[3:6].title()], int(text[7:11]), text[12:]
        elif layout.startswith("AAA"):
            mo, d, clock = MONTHS[text[:3].title()], int(text[4:6]), text[7:]
        else:
            mo, d, clock = int(text[1:3]), int(text[3:5]), text[6:]
        h, m, s = (int(x) for x in clock.split(":"))
        base = datetime(y, mo, d, tzinfo=timezone.utc).timestamp()
    except (ValueError, KeyError):
        return None
    if h > 24 or m > 59 or s > 60:
        return None
    return int(base) + h * 3600 + m * 60 + s


def millis(line: str, at: int, hit: tuple[int, str, int, str, str], year: int) -> int | None:
    """Milliseconds since 1970 UTC of a scanned time stamp; NULL if it is no date."""
    _, layout, body, fraction, zone = hit
    s = _seconds(layout, line[at:body], year)
    if s is None:
        return None
    if zone not in ("", "Z"):
        shift = int(zone[1:3]) * 3600 + int(zone[3:5]) * 60
        s -= shift if zone[0] == "+" else -shift
    return s * 1000 + int((fraction + "000")[:3])


CLOSERS = {"[": "]", "(": ")"}
WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-/\\@#$+")


def tokens(line: str, at: int, most: int) -> list[tuple[str, str, int]]:
    """Up to ``most`` tokens from ``at``: (kind, text, end).

    Kinds: ``w`` word, ``s`` spaces, ``[`` and ``(`` bracketed group (text
    without the brackets), ``q`` quoted string (unescaped), else the delimiter
    itself.  Colour codes (ESC [ ... letter) are passed over.
    """
    out: list[tuple[str, str, int]] = []
    pos, n = at, len(line)
    while pos < n and len(out) < most:
        ch = line[pos]
        start = pos
        if ch == "\x1b":
            pos += 1
            if pos < n and line[pos] == "[":
                pos += 1
                while pos < n and not line[pos].isalpha():
                    pos += 1
            pos += 1
        elif ch in WORD or ch.isalnum():
            while pos < n and (line[pos] in WORD or line[pos].isalnum()):
                pos += 1
            out.append(("w", line[start:pos], pos))
        elif ch == " " or ch == "\t":
            while pos < n and line[pos] in " \t":
                pos += 1
            out.append(("s", " ", pos))
        elif ch in CLOSERS:
            stop = line.find(CLOSERS[ch], pos + 1)
            if stop < 0:
                break
            pos = stop + 1
            out.append((ch, line[start + 1 : stop], pos))
        elif ch == '"':
            pos += 1
            while pos < n and line[pos] != '"':
                pos += 2 if line[pos] == "\\" else 1
            if pos >= n:
                break
            pos += 1
            out.append(("q", line[start + 1 : pos - 1], pos))
        else:
            pos += 1
            out.append((ch, ch, pos))
    return out


#: Grammars of what follows a time stamp: token kinds, and the place of level
#: and component among them.  An upper-case letter stands for the same kind.
GRAMMARS = [
    ("sws[", 1, 3),  #  LEVEL [component]
    ("s[s[", 1, 3),  #  [LEVEL] [component]
    ("s[sw:", 1, 3),  #  [LEVEL] component:
    ("sws(", 1, 3),  #  LEVEL (component)
    ("swsw:", 1, 3),  #  LEVEL component:
    ("swswswswsws", 7, 3),  #  - component - LEVEL -
    ("swswswswsws", 3, 7),  #  - LEVEL - component -
    ("s|sws|sws|", 3, 7),  #  | LEVEL | component |
    ("s(sw:", 3, 1),  #  (component) LEVEL:
    ("s[sw:", 3, 1),  #  [component] LEVEL:
]
JSON_LEVEL = ("level", "severity", "lvl", "levelname")
JSON_COMPONENT = ("logger", "component", "name", "source", "module", "service")
JSON_TIME = ("time", "ts", "timestamp", "@timestamp")
JSON_MESSAGE = ("message", "msg", "text", "event")
Head = tuple[int, str, str, int]  # milliseconds or -1, level, component, start of the message


def _fit(line: str, toks: list[tuple[str, str, int]], grammar: tuple[str, int, int]) -> tuple[str, str, int] | None:
    kinds, level_at, component_at = grammar
    if len(toks) < len(kinds):
        return None
    for want, (kind, _, _) in zip(kinds, toks, strict=False):
        if want != kind:
            return None
    level = LEVELS.get(toks[level_at][1].lower())
    component = toks[component_at][1]
    if level is None or not component or len(toks[level_at][1]) < 3:
        return None
    if kinds == "swswswswsws" and any(toks[i][1] != "-" for i in (1, 5, 9)):
        return None
    return level, component, toks[len(kinds) - 1][2]


def _value_ms(value: object, year: int) -> int:
    if isinstance(value, bool) or value is None:
        return -1
    if isinstance(value, (int, float)):
        return int(value) if abs(value) >= 1e11 else int(value * 1000)
    hit = scan_time(str(value))
    got = millis(str(value), 0, hit, year) if hit else None
    return -1 if got is None else got


def _json_head(line: str, year: int) -> tuple[Head, str] | None:
    try:
        o = json.loads(line)
    except ValueError:
        return None
    if not isinstance(o, dict):
        return None
    pick = lambda names: next((o[k] for k in names if k in o), None)
    level, component = pick(JSON_LEVEL), pick(JSON_COMPONENT)
    if not isinstance(level, str) or not isinstance(component, str) or not component:
        return None
    level = LEVELS.get(level.lower())
    if level is None:
        return None
    message = pick(JSON_MESSAGE)
    text = message if isinstance(message, str) else "" if message is None else json.dumps(message)
    return (_value_ms(pick(JSON_TIME), year), level, component, len(line)), text


def _pairs(line: str) -> dict[str, tuple[str, int]] | None:
    """key=value pairs of a whole line, or None if it isn't one."""
    out: dict[str, tuple[str, int]] = {}
    pos, n = 0, len(line)
    while pos < n:
        start = pos
        while pos < n and (line[pos].isalnum() or line[pos] in "_.-@"):
            pos += 1
        if pos == start or pos >= n or line[pos] != "=":
            return out or None
        key = line[start:pos]
        pos += 1
        start = pos
        if pos < n and line[pos] == '"':
            pos += 1
            while pos < n and line[pos] != '"':
                pos += 2 if line[pos] == "\\" else 1
            value = line[start + 1 : min(pos, n)].replace('\\"', '"').replace("\\\\", "\\")
            pos += 1
        else:
            while pos < n and line[pos] not in " \t":
                pos += 1
            value = line[start:pos]
        out.setdefault(key, (value, pos))
        while pos < n and line[pos] in " \t":
            pos += 1
    return out


def _pair_head(line: str, year: int) -> tuple[Head, str] | None:
    pairs = _pairs(line)
    if not pairs:
        return None
    pick = lambda names: next((pairs[k][0] for k in names if k in pairs), None)
    level, component = pick(JSON_LEVEL), pick(JSON_COMPONENT)
    level = LEVELS.get((level or "").lower())
    if level is None or not component:
        return None
    stamp = pick(JSON_TIME)
    try:
        ms = _value_ms(float(stamp) if stamp and stamp.replace(".", "", 1).isdigit() else stamp, year)
    except ValueError:
        ms = -1
    return (ms, level, component, len(line)), pick(JSON_MESSAGE) or ""


def _prover_head(line: str) -> Head | None:
    """``file:line:column: severity: message`` with an optional kind in parentheses."""
    pos, n = 0, len(line)
    while True:
        colon = line.find(":", pos)
        if colon <= 0:
            return None
        p = colon + 1
        while p < n and "0" <= line[p] <= "9":
            p += 1
        if p > colon + 1 and p < n and line[p] == ":":
            q = p + 1
            while q < n and "0" <= line[q] <= "9":
                q += 1
            if q > p + 1 and q + 1 < n and line[q] == ":" and line[q + 1] == " ":
                toks = tokens(line, q + 2, 3)
                if not toks or toks[0][0] != "w":
                    return None
                level = LEVELS.get(toks[0][1].lower())
                rest = toks[1:]
                if rest and rest[0][0] == "(":
                    rest = rest[1:]
                if level is None or len(toks[0][1]) < 3 or not rest or rest[0][0] != ":":
                    return None
                return -1, level, line[:colon], rest[0][2]
        pos = colon + 1


def _glog_head(line: str, hit: tuple[int, str, int, str, str], year: int) -> Head | None:
    """``Lmmdd hh:mm:ss.uuuuuu thread file:line] message``"""
    level = LEVELS.get(line[0].lower())
    toks = tokens(line, hit[0], 7)
    if level is None or len(toks) < 6 or [t[0] for t in toks[:6]] != ["s", "w", "s", "w", ":", "w"]:
        return None
    if not toks[1][1].isdigit() or not toks[5][1].isdigit() or line[toks[5][2] : toks[5][2] + 1] != "]":
        return None
    ms = millis(line, 0, hit, year)
    return None if ms is None else (ms, level, toks[3][1], toks[5][2] + 1)


def _syslog_head(line: str, hit: tuple[int, str, int, str, str], year: int) -> Head | None:
    """``Mon dd hh:mm:ss host program[pid]: LEVEL: message``"""
    toks = tokens(line, hit[0], 9)
    kinds = "".join(t[0] for t in toks)
    for shape, program, level_at in (("swsw[:sw:", 3, 7), ("swsw:sw:", 3, 6)):
        if kinds.startswith(shape):
            level = LEVELS.get(toks[level_at][1].lower())
            ms = millis(line, 0, hit, year)
            if level and len(toks[level_at][1]) >= 3 and ms is not None:
                return ms, level, toks[program][1], toks[len(shape) - 1][2]
    return None


def head(line: str, year: int) -> tuple[Head, str | None] | None:
    """The head of a line, and the message where it doesn't simply follow."""
    if not line:
        return None
    first = line[0]
    if first == "{":
        return _json_head(line, year) if line.rstrip().endswith("}") else None
    if first in " \t}":
        return None
    hit = scan_time(line)
    if hit is not None:
        if hit[1].startswith("A9"):
            got = _glog_head(line, hit, year)
        elif hit[1].startswith("AAA"):
            got = _syslog_head(line, hit, year)
        else:
            got = None
        if got is None:
            toks = tokens(line, hit[0], 11)
            for grammar in GRAMMARS:
                fit = _fit(line, toks, grammar)
                if fit is not None:
                    ms = millis(line, 0, hit, year)
                    return ((ms, *fit), None) if ms is not None else None
        return (got, None) if got else None
    if first == "[":  # [seconds] (component) LEVEL:
        stop = line.find("]", 1, 40)
        whole, dot, part = line[1:stop].partition(".") if stop > 0 else ("", "", "")
        if whole.isdigit() and (not dot or part.isdigit()):
            toks = tokens(line, stop + 1, 11)
            for grammar in GRAMMARS:
                fit = _fit(line, toks, grammar)
                if fit is not None:
                    return (int(whole) * 1000 + int((part + "000")[:3]), *fit), None
        return None
    if "=" in line:
        got = _pair_head(line, year)
        if got:
            return got
    got = _prover_head(line)
    return (got, None) if got else None


def entries(text: str, year: int) -> list[tuple[int, int, str, str, str]]:
    """(line number, ms, level, component, message) of each entry of a stream.

    Lines without a head are the continuation of the entry before them; those
    before the first head belong to none.  A carriage return before the line
    feed is no part of a line; colour codes are no part of a message.
    """
    out: list[tuple[int, int, str, str, str]] = []
    now: list | None = None
    more: list[str] = []

    def close() -> None:
        if now is not None:
            out.append((now[0], now[1], now[2], now[3], "\n".join([now[4], *more]).rstrip("\n")))

    for number, line in enumerate(text.split("\n"), 1):
        if line.endswith("\r"):
            line = line[:-1]
        got = head(line, year)
        if got is None:
            if now is not None:
                more.append(line)
            continue
        close()
        (ms, level, component, start), message = got
        if message is None:
            message = line[start:].lstrip(" ").removeprefix("- ")
        now, more = [number, ms, level, component, message], []
    close()
    return out
