"""Columns over Markdown text: normal forms, counts and first-match classifiers. All are built-in expressions but for NFC."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are folded, and patterns that decide results.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
FOLDED, FOLDED_TO = "“”‘’–−", "\"\"''--"
PY_SPACE = r"[\s\x1c-\x1f]"
TOKEN = r"(?U)[^\s\x1c-\x1f]+"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE = r"(?U)[.!?][\s\x1c-\x1f]+[A-ZÁÉÍÓÚÂÊÔÃÕÇ]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
MATH_SEGMENT = r"(?s)(\$\$.*?\$\$|\$[^$\n]+?\$)"
INLINE_MATH = r"(?<!\\)\$[^$\n]+?\$"
LATEX_COMMAND = r"\\([a-zA-Z]+)"
ESCAPE = r"\\([\\`*_{}\[\]()#+\-.!])"
PASS2_SIGNS = "[=∑∫√≤≥≠αβγδλμνπσφψωΣΦΨΩ∇∂±×·→^]"
FRACTION = r"(?U)\b\d+/\d+\b"
PROBE_MATH = r"[=∑∫√≤≥≠αβγδλΣΦΨΩ]|(?U:\b\d+/\d+\b)|\^|\\[a-zA-Z]+"
SECTION = r"^(\d+)((?:\.\d+)*)\s+[A-Z][a-z]"


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode normal form C, for which there is no built-in."""
    return F.pandas_udf(_nfc, "string")(text)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{PY_SPACE}+|{PY_SPACE}+\z", "")


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` occurs, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def fold_characters(text: Column) -> Column:
    for old, new in LIGATURES.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return nfc(F.translate(text, FOLDED, FOLDED_TO))


def join_hyphenation(text: Column) -> Column:
    word = r"[\p{L}\p{N}_]"
    for gap in ("\n", " "):
        text = F.regexp_replace(text, f"({word})-{gap}({word})", "$1$2")
    return text


def normalize_md(text: Column, strip_escapes: bool = False) -> Column:
    """Without page markers, image folders and surplus white space, and without escapes if asked."""
    text = F.regexp_replace(text, r"\{\d+\}", "")
    text = F.regexp_replace(text, r"(?i)<!--\s*page\s*\d+\s*-->", "")
    text = F.regexp_replace(text, r"!\[([^\]]*)\]\((?:[^)]*/)?([^)/]+)/*\)", "![$1]($2)")
    if strip_escapes:
        text = F.regexp_replace(text, ESCAPE, "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(text)


def normalize_for_comparison(text: Column) -> Column:
    text = F.regexp_replace(F.lower(nfc(text)), ESCAPE, "$1")
    return strip(F.regexp_replace(text, rf"(?U){PY_SPACE}+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalize_md(text), F.lit(TOKEN), 0)


def line_count(text: Column) -> Column:
    body = F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(body, LINE_BREAK))).cast("long")


def metrics(text: Column) -> dict[str, Column]:
    """The per-document Markdown metrics by name."""
    segments = F.array_join(F.regexp_extract_all(text, F.lit(MATH_SEGMENT), 0), "\n")
    commands = F.regexp_extract_all(segments, F.lit(LATEX_COMMAND), 1)
    return {
        "size_bytes": F.octet_length(text).cast("long"),
        "lines": line_count(text),
        "tokens": matches(text, TOKEN),
        "words": matches(text, WORD),
        "sentences_estimated": matches(text, SENTENCE),
        "h1": matches(text, r"(?md)^# [^#]"),
        "h2": matches(text, r"(?md)^## [^#]"),
        "h3": matches(text, r"(?md)^### [^#]"),
        "h4_plus": matches(text, r"(?md)^####+ "),
        "math_display": F.floor(occurrences(text, "$$") / 2).cast("long"),
        "math_inline": matches(text, INLINE_MATH),
        "latex_cmd_count": F.size(commands).cast("long"),
        "latex_cmd_unique": F.size(F.array_distinct(commands)).cast("long"),
        "ligature_artifacts": matches(text, "[ﬀ-ﬄ]"),
        "tables_rough": F.floor(matches(text, r"(?md)^\|.*\|$") / 2).cast("long"),
        "code_blocks": F.floor(occurrences(text, "```") / 2).cast("long"),
        "images_referenced": matches(text, IMAGE),
    }


def math_hits(text: Column) -> Column:
    """Signs, fractions, subscripts and commands of mathematics. No two kinds share a character, so each is counted alone, and the costly ones only in texts that can hold them."""
    has = lambda part: F.contains(text, F.lit(part))
    fractions = F.when(has("/"), matches(text, FRACTION)).otherwise(0)
    commands = F.when(has("\\"), matches(text, LATEX_COMMAND)).otherwise(0)
    return matches(text, PASS2_SIGNS) + fractions + occurrences(text, "_{") + commands


def latex_commands(text: Column) -> Column:
    """Array of the commands inside math, in order."""
    return F.regexp_extract_all(F.array_join(F.regexp_extract_all(text, F.lit(MATH_SEGMENT), 0), "\n"), F.lit(LATEX_COMMAND), 1)


def divergence_category(a: Column, b: Column) -> Column:
    """First match over both sides; emphasis comes before images, so a name with an underscore is emphasis."""
    s = F.concat(a, F.lit(" "), b)
    has = lambda x: F.contains(s, F.lit(x))
    return (
        F.when(strip(s) == "", "whitespace")
        .when(s.rlike(r"https?://|ftp://"), "other")
        .when(has("$") | s.rlike(r"\\[a-zA-Z]+"), "math")
        .when(s.rlike(r"(?:^|\n)#+ "), "heading")
        .when(has("**") | has("_"), "emphasis")
        .when(has("![") | has(".jpeg") | has(".png") | has(".svg"), "image_ref")
        .when(has("|"), "table")
        .when(has("---"), "separator")
        .otherwise("other")
    )


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 60)


def byte_size(n: Column) -> Column:
    """Bytes as an integer, larger units of 1024 with one decimal, halves to even."""
    n = n.cast("double")
    steps = [("KB", 1), ("MB", 2), ("GB", 3), ("TB", 4)]
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for unit, k in steps:
        shown = F.concat(F.bround(n / float(1024**k), 1).cast("decimal(30,1)").cast("string"), F.lit(f" {unit}"))
        out = out.otherwise(shown) if unit == "TB" else out.when(n < float(1024 ** (k + 1)), shown)
    return out


def heading_level(raw: Column, max_size: Column, body: Column) -> Column:
    """Numbered sections by their depth; else by size, if the text holds three letters in a row; 0 for none."""
    s = strip(raw)
    number = F.regexp_extract(s, r"^\d+((?:\.\d+)*)", 1)
    depth = F.least(F.lit(2) + F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))), F.lit(6))
    letters = s.rlike("[A-Za-z]{3,}")
    return F.when((F.length(s) < 70) & s.rlike(SECTION), depth).when(letters & (max_size >= body * 1.6), 2).when(letters & (max_size >= body * 1.25), 3).otherwise(0).cast("long")


def is_page_number(raw: Column) -> Column:
    return raw.rlike(r"^\d{1,3}$")


def localise_images(text: Column, folder: str = "images") -> Column:
    return F.regexp_replace(text, r"!\[([^\]]*)\]\((?:[^)]*/)?([^)/]+)\)", f"![$1]({folder}/$2)")


def paragraphs(text: Column) -> Column:
    """Array of paragraphs between blank lines, inner line ends as blanks."""
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: strip(F.regexp_replace(p, r"\s*\n\s*", " ")))
    return F.filter(parts, lambda p: p != "")


def fenced_diagrams_to_html(text: Column, language: str = "mermaid") -> Column:
    """Fenced blocks of a diagram language as raw HTML."""
    return F.regexp_replace(text, rf"(?ms)^```{language}\n(.*?)\n```$", f'<pre class="{language}">$1</pre>')
