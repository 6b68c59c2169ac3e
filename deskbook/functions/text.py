"""Text expressions on columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that searches ignore.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "i", "if", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with", "you", "your")


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition leaves of characters outside ASCII, all but a-z, 0-9 and white space as spaces.

    Two tables by rule: characters that become one letter or digit and at most one run of spaces behind it, and the few that
    become several (ligatures, fractions, numbers in brackets).
    """
    single, several = {}, {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7B0 or c.lower() != c:
            continue
        parts = unicodedata.normalize("NFKD", c)
        left = re.sub(r"[^a-z0-9\s]", " ", parts)
        if parts != c and re.search("[a-z0-9]", left):
            (single if re.fullmatch(r"[a-z0-9] *", left) else several)[c] = left
    return single, several


#: Lower-case characters whose decomposition holds a letter or digit.
SINGLE, SEVERAL = _decompositions()
MARKED = "".join(c for c, to in SINGLE.items() if len(to) > 1)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s++|(?<!\s)\s++$", "")


def strip_end(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)(?<!\s)\s++$", "")


def compact(c) -> Column:
    """White space collapsed to single spaces."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def normalize_whitespace(c) -> Column:
    c = F.regexp_replace(col(c), "\r\n", "\n")
    c = F.regexp_replace(c, "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def strip_markdown(c) -> Column:
    """Plain text of Markdown: code fences and images go, links and inline code keep their text, markers of lines go."""
    for pattern, to in (
        (r"```[\s\S]*?```", " "), (r"`([^`]+)`", "$1"), (r"!\[[^\]]*\]\([^\)]+\)", " "), (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
        (r"(?m)^#+\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""),
    ):
        c = F.regexp_replace(col(c), pattern, to)
    return normalize_whitespace(c)


def estimate_tokens(c) -> Column:
    """The corpus estimate: a quarter of the characters, rounded down, one at least unless empty."""
    n = F.length(col(c))
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 4))).otherwise(0).cast("int")


def estimate_service_tokens(c) -> Column:
    """The service's estimate: of the trimmed text, rounded up."""
    n = F.length(strip(c))
    return F.when(n > 0, F.greatest(F.lit(1), F.ceil(n / 4))).otherwise(0).cast("int")


def clean_chunk_text(c) -> Column:
    for pattern, to in ((r"(?m)^>\s?", ""), (" ", " "), ("\r", ""), ("[ \t]+", " "), ("\n{3,}", "\n\n")):
        c = F.regexp_replace(col(c), pattern, to)
    return strip(c)


def tokenize(c) -> Column:
    """Search terms: lower case, marks split off letters, all but letters and digits dropped, short words and stop words gone."""
    c = F.lower(col(c))
    plain = lambda c, of: F.translate(F.regexp_replace(c, f"([{''.join(x for x in of if x in MARKED)}])", "$1 "), "".join(of), "".join(to[0] for to in of.values()))
    one_by_one = F.split(F.lit("|".join(x + to for x, to in SEVERAL.items())), r"\|")  # folded to one literal
    any_script = plain(F.aggregate(one_by_one, c, lambda acc, e: F.replace(acc, F.substring(e, 1, 1), F.substring(e, F.lit(2), F.length(e)))), SINGLE)
    c = F.when(c.rlike(r"[^\x00-\xbb\xbf-\xff]"), any_script).otherwise(plain(c, {x: to for x, to in SINGLE.items() if x <= "\xff"}))  # Latin letters need short tables
    words = F.split(F.regexp_replace(c, r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def thread_title(content, default: str = "New thread") -> Column:
    text = compact(content)
    return F.when(text == "", default).when(F.length(text) <= 72, text).otherwise(F.concat(strip_end(F.substring(text, 1, 69)), F.lit("...")))


BLANK, SOURCES = r"^[^\S\n]*$", r"(?i)^[^\S\n]*sources[^\S\n]*:?[^\S\n]*$"
SOURCE_LINE = r"(?i)^[^\S\n]*(?:\[\d+\]|\d+\.|-[^\S\n]*\[\d+\]|-)[^\S\n]+https?://\S+[^\S\n]*$"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip_trailing_sources(content) -> Column:
    """Without a closing list of sources: a heading line and address lines alone, to the end.

    Read line by line: the last line that is neither blank nor an address must be the heading.
    """
    text = F.regexp_replace(col(content), "\r\n", "\n")

    other = lambda line: ~line.rlike(BLANK) & ~line.rlike(SOURCE_LINE)

    def cut(lines):
        last = F.coalesce(F.array_max(F.transform(lines, lambda line, i: F.when(other(line), i))), F.lit(-1))
        source = F.coalesce(F.array_max(F.transform(lines, lambda line, i: F.when(line.rlike(SOURCE_LINE), i))), F.lit(-1))
        ends = let(F.struct(last.alias("last"), source.alias("source")), lambda e: F.when((e["source"] > e["last"]) & (e["last"] >= 0) & F.get(lines, e["last"]).rlike(SOURCES), e["last"]))
        return let(ends, lambda n: F.when(n.isNotNull(), strip_end(F.array_join(F.slice(lines, F.lit(1), n), "\n"))))

    return F.coalesce(let(F.split(text, "\n"), cut), F.when(strip(text) == "", F.lit("")).otherwise(text))


def space_citations(content) -> Column:
    """``[1][2]`` -> ``[1] [2]``."""
    return F.regexp_replace(col(content), r"\[(\d+)\](?=\[\d+\])", r"[$1] ")


def join_list_continuations(content) -> Column:
    """Wrapped lines of list items joined to their item, outside code fences.

    Lines are folded in blocks, whose results are put together at the end: the work stays linear in the text.
    """
    lines = F.split(F.regexp_replace(col(content), "\r\n", "\n"), "\n")
    none = F.array().cast("array<string>")

    def step(acc, line):
        trimmed, last = strip(line), acc["last"]
        fence = trimmed.startswith("```")
        joins = ~acc["fence"] & last.isNotNull() & line.rlike(r"^\s{2,}\S") & ~trimmed.rlike(r"^(?:(?:[-*]|\d+\.)\s+|>|\||```)") & last.rlike(r"^\s*(?:[-*]|\d+\.)\s+")
        joined = ~fence & F.coalesce(joins, F.lit(False))
        out = F.when(joined | last.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(last)))
        return F.struct(out.alias("out"), F.when(joined, F.concat(strip_end(last), F.lit(" "), trimmed)).otherwise(line).alias("last"), F.when(fence, ~acc["fence"]).otherwise(acc["fence"]).alias("fence"))

    def block(acc, own):
        start = F.struct(none.alias("out"), acc["last"].alias("last"), acc["fence"].alias("fence"))
        return F.aggregate(own, start, step, lambda done: F.struct(F.concat(acc["out"], F.array(done["out"])).alias("out"), done["last"].alias("last"), done["fence"].alias("fence")))

    zero = F.struct(F.array().cast("array<array<string>>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(False).alias("fence"))
    return let(lines, lambda own: F.aggregate(in_blocks(own), zero, block, lambda acc: F.array_join(F.concat(F.flatten(acc["out"]), F.array(acc["last"])), "\n")))


def in_blocks(array: Column, size: int = 256) -> Column:
    """An array in slices of ``size`` elements."""
    count = F.ceil(F.size(array) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(array, i * size + 1, F.lit(size)))).otherwise(F.array())


def mask_secret(c) -> Column:
    """Eight stars and the last four characters of a key; the stars alone for keys of four characters or fewer."""
    key = strip(c)
    return F.when(F.length(key) <= 4, F.lit("*" * 8)).otherwise(F.concat(F.lit("*" * 8), F.right(key, F.lit(4))))


# What an audit token may look like, and what gives a secret away.
SAFE_TOKEN, SAFE_REASON = r"^[A-Za-z0-9._:-]{1,128}$", r"^[a-z0-9_.:-]{1,80}$"
SENSITIVE = r"(?i)(sk-[a-z0-9]|apikey|api[-_]?key|bearer|token|AIza)"


def safe_token(c, fallback: str | None) -> Column:
    value = strip(c)
    return F.when(col(c).isNull() | (col(c) == ""), F.lit(fallback)).when(value.rlike(SAFE_TOKEN) & ~value.rlike(SENSITIVE), value).otherwise(F.lit(fallback))


def safe_reason(c) -> Column:
    value = F.lower(strip(c))
    return F.when(col(c).isNull() | (col(c) == ""), F.lit(None)).when(value.rlike(SAFE_REASON) & ~value.rlike(SENSITIVE), value).otherwise(F.lit("redacted_reason"))
