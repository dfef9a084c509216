"""String, path and formatting column functions (JVM-side, codegen-friendly).

All helpers take and return ``Column`` so they compose inside one
``select`` and stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every character for which str.isspace() is
# true; Spark's one-argument trim only removes spaces.  The set is derived
# from Python itself and passed to trim(BOTH set FROM x), which only looks at
# the two ends of the string (a regex would probe every inner whitespace run).
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python-style ``strip()``: remove leading/trailing whitespace."""
    return F.trim(_c(x), F.lit(PY_WHITESPACE))


def py_regex(pattern: str, ignore_case: bool = True) -> str:
    """Translate a Python ``re`` pattern for Java's engine.

    Named groups ``(?P<n>`` become ``(?<n>``; case-insensitive search is
    Unicode-aware as in Python (``(?iu)``).
    """
    p = pattern.replace("(?P<", "(?<").replace("(?P=", "\\k<")
    return ("(?iu)" if ignore_case else "") + p


def split_lines(text) -> Column:
    """Physical lines of a text: split on CRLF/LF/CR, drop one trailing ''.

    Mirrors ``str.splitlines()`` for the three newline forms.  One trailing
    newline is cut off first (a suffix test, no regex); texts without CR
    are split on a single character, which takes Java's split fast path.
    """
    t = _c(text)
    n = F.length(t)
    body = (F.when(F.endswith(t, F.lit("\r\n")), F.substring(t, F.lit(1), n - 2))
            .when(F.endswith(t, F.lit("\n")) | F.endswith(t, F.lit("\r")), F.substring(t, F.lit(1), n - 1))
            .otherwise(t))
    lines = F.when(F.contains(body, F.lit("\r")), F.split(body, r"\r\n|\n|\r", -1)).otherwise(F.split(body, "\n", -1))
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(lines)


def basename(path) -> Column:
    """``os.path.basename`` / ``split('/')[-1]``."""
    return F.element_at(F.split(_c(path), "/", -1), -1)


def dirname(path) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def stem(path) -> Column:
    """Basename without its last extension."""
    b = basename(path)
    return F.when(b.rlike(r"^.+\.[^.]*$"), F.regexp_extract(b, r"^(.*)\.[^.]*$", 1)).otherwise(b)


def extension(path) -> Column:
    """Lower-case extension including the dot ('' if none)."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


# fixed values: characters a file name may not contain (replaced by '_')
FORBIDDEN_NAME_CHARS = r'[<>:"/\\|?*]'


def sanitize_name(x, default: str = "sheet") -> Column:
    """forbidden characters -> '_', trim, '' -> default."""
    s = py_strip(F.regexp_replace(_c(x), FORBIDDEN_NAME_CHARS, "_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


# fixed value: the tool-result length limit and its note
MAX_TOOL_RESPONSE = 6144


def clip_tail(x, max_chars: int = MAX_TOOL_RESPONSE) -> Column:
    """longer than ``max_chars`` -> note + the last ``max_chars`` chars."""
    s = _c(x)
    # fixed value: the note format put in front of a clipped result
    note = F.concat(F.lit("[Truncated leading part, original length: "),
                    F.length(s).cast("string"), F.lit("] ...\n"))
    return F.when(F.length(s) > max_chars, F.concat(note, F.substring(s, -max_chars, max_chars))).otherwise(s)


def line_label(line_no, line, width: int = 3) -> Column:
    """right-aligned number + '| ' + right-stripped text.

    ``lpad`` truncates, so the width grows with the number.
    """
    n = _c(line_no).cast("string")
    return F.concat(F.lpad(n, F.greatest(F.lit(width), F.length(n)), " "), F.lit("| "),
                    F.regexp_replace(_c(line), r"\s+$", ""))


def token_count(x) -> Column:
    """F14 default tokenizer: words and single punctuation marks."""
    return F.coalesce(F.regexp_count(_c(x), F.lit(r"\w+|[^\w\s]")), F.lit(0))


def safe_float(x) -> Column:
    """parse as double, else 0.0 (strings, NULL, junk)."""
    return F.coalesce(F.expr(f"try_cast({x} AS DOUBLE)") if isinstance(x, str) else x.try_cast("double"),
                      F.lit(0.0))
