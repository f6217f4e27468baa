"""Fixed values that decide results: field aliases, level names, colours.

Everything here is data, kept in its natural order; the order of an alias list is its priority.
"""

from __future__ import annotations

# Aliases of each role, highest priority first. Roles are consumed in this order.
ROLE_ALIASES = {
    "timestamp": (
        "time", "ts", "timestamp", "@timestamp", "datetime", "date", "t", "logged_at", "created_at",
    ),
    "level": ("level", "severity", "loglevel", "log_level", "lvl", "priority", "log.level"),
    "message": ("msg", "message", "text", "log", "body", "event", "short_message"),
    "logger": ("logger", "name", "logger_name", "component", "module"),
    "caller": ("caller", "source", "src", "location", "file", "func", "function"),
    "error": ("error", "err", "exception", "exc_info", "stack_trace", "stacktrace", "stack"),
}

ROLES = tuple(ROLE_ALIASES)

# Severity number of each level and the lower-cased names that mean it.
LEVEL_NUMBERS = {"trace": 10, "debug": 20, "info": 30, "warn": 40, "error": 50, "fatal": 60}

LEVEL_NAMES = {
    "trace": ("trace", "trc"),
    "debug": ("debug", "dbg"),
    "info": ("info", "inf", "information"),
    "warn": ("warn", "warning", "wrn"),
    "error": ("error", "err", "fatal_error"),
    "fatal": ("fatal", "critical", "crit", "panic", "emerg", "emergency"),
}

# A numeric level below the bound (and not below an earlier one) is that level.
LEVEL_UPPER_BOUNDS = (("trace", 15), ("debug", 25), ("info", 35), ("warn", 45), ("error", 55))

# Default badge colour of each level, and the ANSI code of each colour name.
LEVEL_COLORS = {
    "trace": "cyan",
    "debug": "blue",
    "info": "green",
    "warn": "yellow",
    "error": "red",
    "fatal": "magenta",
}

COLOR_CODES = {
    "black": 30, "red": 31, "green": 32, "yellow": 33,
    "blue": 34, "magenta": 35, "purple": 35, "cyan": 36, "white": 37,
    "bright_black": 90, "bright_red": 91, "bright_green": 92, "bright_yellow": 93,
    "bright_blue": 94, "bright_magenta": 95, "bright_cyan": 96, "bright_white": 97,
}

# Unicode White_Space, the characters stripped from both ends of a line.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# First and last whole second of the supported calendar (years -9999 to 9999).
MIN_EPOCH_SECOND = -377705023201
MAX_EPOCH_SECOND = 253402207200

# An epoch number below the first bound is in seconds, below the second in
# milliseconds, otherwise in nanoseconds.
SECONDS_BELOW = 1_000_000_000_000
MILLIS_BELOW = 1_000_000_000_000_000

# Strftime directive -> Spark datetime pattern.
STRFTIME_PATTERNS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%3f": "SSS", "%6f": "SSSSSS", "%.3f": ".SSS", "%.6f": ".SSSSSS",
    "%j": "DDD", "%a": "EEE", "%A": "EEEE", "%b": "MMM", "%h": "MMM", "%B": "MMMM", "%p": "a",
    "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm", "%D": "MM/dd/yy",
    "%%": "%",
}
