"""Column expressions over text that stay in the JVM, and the regex pieces shared with SQL checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space as Unicode has it; the class is written out because engines disagree about ``\s``
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = f"[^{SPACE}]+"
#: a normalised word (fixed value)
NORM_WORD = "[a-z0-9]+(?:['’][a-z]+)?"
#: an ASCII word boundary; ``\b`` is not the same in all engines
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(c: str | Column) -> Column:
    return F.coalesce(F.regexp_count(col(c), F.lit(WORD)), F.lit(0)).cast("long")


def words(c: str | Column) -> Column:
    """Runs of anything but white space; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(col(c), F.lit(WORD), 0), F.array().cast("array<string>"))


def norm_words(c: str | Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(col(c)), F.lit(NORM_WORD), 0), F.array().cast("array<string>"))


def collapse(c: str | Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), f"[{SPACE}]+", " "))


def strip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def lines(c: str | Column) -> Column:
    return F.split(F.coalesce(col(c), F.lit("")), "\n")


def count_of(c: str | Column, sign: str) -> Column:
    """Occurrences of a literal."""
    return ((F.length(col(c)) - F.length(F.replace(col(c), F.lit(sign), F.lit("")))) / len(sign)).cast("long")


def clip(c: str | Column, n: int = 90, left: bool = False) -> Column:
    s = collapse(c)
    short = F.concat(F.lit("…"), F.ltrim(F.right(s, F.lit(n)))) if left else F.concat(F.rtrim(F.left(s, F.lit(n))), F.lit("…"))
    return F.when(F.length(s) <= n, s).otherwise(short)


def masked(c: str | Column) -> Column:
    """A value as it may be shown: mail keeps its first sign and domain, numbers their last four digits."""
    s = strip(c)
    digits = F.regexp_replace(s, r"[^0-9]", "")
    return (
        F.when(s.contains("@"), F.concat(F.left(s, F.lit(1)), F.lit("***@"), F.substring_index(s, "@", -1)))
        .when(F.length(digits) >= 4, F.concat(F.lit("***"), F.right(digits, F.lit(4))))
        .otherwise("***")
    )


# ---------------------------------------------------------------- lines that look like table rows
#: a number as it stands in a table cell (fixed value)
NUMBER_TOKEN = r"(?i)^(?:[(\[]?[-+−±~<>≈]?[$€£¥]?\d[\d,.:/]*(?:%|[kmb]n?|x)?[)\]]?[,;]?|[-–—]|n/?a)$"
BULLET = f"^(?:[-*•▪◦]|\\d{{1,2}}[.)])[{SPACE}]+"


def is_number_token(c: Column) -> Column:
    return c.rlike(NUMBER_TOKEN)


def is_table_row(line: str | Column, allow_pipes: Column | bool = True) -> Column:
    """Cells joined by bars, three cells apart by tabs or wide gaps with a number, or mostly numbers."""
    raw = strip(line)
    s = F.regexp_replace(raw, BULLET, "")
    return table_row_of(raw, s, words(s), allow_pipes)


def table_row_of(raw: Column, s: Column, toks: Column, allow_pipes: Column | bool = True) -> Column:
    """The rule itself over the stripped line, the line without its bullet and its words.

    Callers with many lines make these columns first, so that no rule computes them again.
    """
    allow = F.lit(allow_pipes) if isinstance(allow_pipes, bool) else allow_pipes
    cells = F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|")
    piped = F.when(allow & s.contains("|"), ~s.contains("||") & (F.size(cells) >= 2) & F.exists(cells, lambda x: strip(x) != "")).otherwise(False)
    gaps = F.filter(F.split(s, r"\t+| {2,}"), lambda x: x != "")
    gapped = F.when(s.rlike(r"\t|  "), (F.size(gaps) >= 3) & F.exists(gaps, lambda x: is_number_token(strip(x)))).otherwise(False)
    # tokens that hold no digit, dash or n/a are no numbers: with too few left the tokens need no closer look
    numbers = F.size(F.filter(toks, is_number_token))
    likely = F.regexp_count(s, F.lit(r"[0-9]+|[-–—]|(?i:n/?a)"))
    numeric = F.when((F.size(toks) >= 3) & (likely >= 2) & (2 * likely >= F.size(toks)), (numbers >= 2) & (2 * numbers >= F.size(toks))).otherwise(False)
    usable = (raw != "") & (F.length(raw) <= 400) & raw.rlike(r"[|0-9]")
    return F.coalesce(F.when(usable, piped | gapped | numeric), F.lit(False))


# ---------------------------------------------------------------- headings
HEADING_MD = f"^#{{1,6}}[{SPACE}]+[^{SPACE}]"
HEADING_NUMBER = f"^(?:[0-9]{{1,2}}\\.(?:[0-9]{{1,2}}\\.?)*|[IVX]+\\.)[{SPACE}]+[A-Z]"


def is_heading(line: str | Column, markdown: Column | bool = True) -> Column:
    """A Markdown heading, a numbered title, or a short line in capitals."""
    s = strip(line)
    md = F.lit(markdown) if isinstance(markdown, bool) else markdown
    n = word_count(s)
    letters = F.regexp_replace(s, r"[^\p{L}]", "")
    plain = (n <= 12) & ~s.rlike("[.,;:?!]$") & ~s.contains("|")
    numbered = s.rlike(HEADING_NUMBER) & (n >= 2)
    capitals = n.between(2, 8) & (F.length(letters) >= 6) & (F.regexp_replace(letters, r"\p{Lu}", "") == "") & (F.regexp_count(s, F.lit("[0-9]")) <= 2)
    return F.coalesce(
        F.when((s == "") | (F.length(s) > 120), False).when(s.startswith("#"), md & s.rlike(HEADING_MD)).otherwise(plain & (numbered | capitals)),
        F.lit(False),
    )


# ---------------------------------------------------------------- rule words
RULE_WORDS = "must|shall|may not|required|eligible|ineligible|prohibited|permitted|policy|entitled|mandatory|in accordance with|no later than"


def rule_density(c: str | Column) -> Column:
    """Rule words per thousand words."""
    hits = F.regexp_count(F.lower(col(c)), F.lit(f"{EDGE}(?:{RULE_WORDS}){EDGE}"))
    return 1000 * F.coalesce(hits, F.lit(0)) / F.greatest(word_count(c), F.lit(1))
