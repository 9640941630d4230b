"""Identifier, path and line functions as column expressions."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings that count as prose, and languages by file ending.
PROSE = ("md", "markdown", "mdx", "rst", "txt", "adoc", "org", "tex")
LANGUAGES = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript",
    "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "md": "markdown", "toml": "toml",
}
NOT_WORD = r"[^\p{L}\p{N}\p{Co}_]+"

_SPLIT = regex.compile(NOT_WORD)


def _accents() -> tuple[str, str]:
    """Lower-case letters that are a base letter with marks, then all marks; and the base letters."""
    marked, base, marks = [], [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif c.isalpha() and len(parts) > 1 and all(unicodedata.category(x) == "Mn" for x in parts[1:]) and parts[0] != c:
            marked.append(c)
            base.append(parts[0])
    return "".join(marked + marks), "".join(base)


_MARKED, _BASE = _accents()


def plain(text: Column) -> Column:
    """Lower case, without accents; only texts beyond ASCII are walked letter by letter."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.translate(low, _MARKED, _BASE)).otherwise(low)


def tokens(text: Column) -> Column:
    """Words in order: runs of letters, digits and underscores, in lower case and without accents."""
    return F.array_remove(F.split(plain(text), NOT_WORD), "")


def python_tokens(text: str) -> list[str]:
    """The same for one text on the driver."""
    low = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return [w for w in _SPLIT.split(unicodedata.normalize("NFC", low)) if w]


def identifier_terms(name: Column) -> Column:
    """Sorted distinct parts of an identifier, cut at case changes and at what is no letter or digit."""
    cut = F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(cut), r"[^\p{L}\p{N}]+"), lambda t: t != "")))


def folded(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def trigrams(text: Column) -> Column:
    last = F.length(text) - 2
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))))


def line_count(text: Column) -> Column:
    """Newlines plus one; an empty text has none."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_at(text: Column, offset: Column) -> Column:
    """The line that holds a character offset, from 1."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_for_path(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.create_map(*pairs)[extension(path)]


def document_class(path: Column) -> Column:
    return F.when(extension(path).isin(*PROSE), "prose").otherwise("code")


def is_test(path: Column, name: Column) -> Column:
    low = F.lower(path)
    return low.contains("test") | low.contains("spec") | name.startswith("test_") | name.endswith("_test") | name.isin("test", "tests", "testing")


def knowledge_group(path: Column) -> Column:
    parts = F.split(path, "/")
    two = F.concat_ws("/", parts[0], parts[1])
    return F.when(F.size(parts) < 2, "(root)").when(parts[0].isin("crates", "apps") & (F.size(parts) > 2), two).otherwise(parts[0])


def estimated_tokens(text: Column) -> Column:
    marks = F.length(text) - F.length(F.regexp_replace(text, r"[{}\[\]();:,.<>/`]", ""))
    return F.floor((F.length(text) + marks) / 4) + 1


def content_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32))


def chunk_bounds(text: Column, most: int) -> Column:
    """Half-open character ranges of at most ``most``, cut after the last newline beyond half of it."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    steps = F.sequence(F.lit(0), F.floor(F.length(text) * 2 / most).cast("int") + 1)

    def step(acc, _):
        piece = F.substring(text, acc["at"] + 1, F.lit(most))
        cut = F.length(piece) - F.coalesce(F.nullif(F.instr(F.reverse(piece), "\n"), F.lit(0)) - 1, F.length(piece))
        whole = acc["at"] + F.length(piece) >= F.length(text)
        size = F.when(~whole & (cut > most / 2), cut).otherwise(F.length(piece))
        one = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + size).cast("int").alias("end")))
        return F.when(size > 0, F.struct((acc["at"] + size).cast("int").alias("at"), F.concat(acc["out"], one).alias("out"))).otherwise(acc)

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])
