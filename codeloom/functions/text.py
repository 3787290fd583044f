"""Column expressions over source texts and paths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file extension (fixed values).
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".html": "html", ".htm": "html", ".css": "css"}
#: Directories whose files are left out, in lower case (fixed values).
IGNORED_DIRECTORIES = ["node_modules", ".git", ".venv", "venv", "__pycache__", "dist", "build", ".next", "coverage", ".pytest_cache", ".mypy_cache", ".tox", ".idea", ".vscode", "__macosx"]
#: File names and name ends of generated and minified files, in lower case (fixed values).
GENERATED_NAMES = ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "composer.lock"]
GENERATED_ENDS = [".bundle.js", ".chunk.js", ".min.js.map", ".js.map", ".css.map"]
MINIFIED_ENDS = [".min.js", ".min.css", ".min.mjs"]
MAX_FILE_BYTES = 512 * 1024


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The lower-case extension; names that start with their only dots have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, extension(path))


def ends_with_any(text: Column, ends: list[str]) -> Column:
    found = F.lit(False)
    for e in ends:
        found = found | F.endswith(text, F.lit(e))
    return found


def path_verdict(path: Column, size: Column, most: int = MAX_FILE_BYTES) -> Column:
    """Why a file is left out by its path and size; null if it is not."""
    parts, name = F.split(path, "/"), F.lower(base_name(path))
    folders = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.lower(p))
    return (
        F.when(F.arrays_overlap(folders, F.array(*[F.lit(d) for d in IGNORED_DIRECTORIES])), "ignored_directory")
        .when(name.isin(GENERATED_NAMES) | ends_with_any(name, GENERATED_ENDS), "generated_file")
        .when(ends_with_any(name, MINIFIED_ENDS), "minified")
        .when(language(path).isNull(), "unsupported_extension")
        .when(size > most, "too_large")
    )


def line_count(text: Column) -> Column:
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def looks_minified(text: Column, lang: Column, size: Column) -> Column:
    """Scripts and style sheets with a very long line, or long lines on average."""
    lines = F.split(text, "\n", -1)
    full = F.filter(lines, lambda x: F.trim(x) != "")
    total = F.aggregate(full, F.lit(0), lambda a, x: a + F.char_length(x))
    longest = F.array_max(F.transform(lines, lambda x: F.char_length(x)))
    long_lines = (size >= 2000) & (F.size(full) > 0) & (total > 200 * F.size(full))
    return F.coalesce(lang.isin("javascript", "css") & ((longest > 1000) | long_lines), F.lit(False))


def decode_verdict(data: Column) -> Column:
    """Why bytes are no source text; null if they are."""
    head = F.hex(F.substring(data, 1, 8192))
    bytes_ = F.regexp_extract_all(head, F.lit("(..)"), F.lit(1))
    controls = F.size(F.filter(bytes_, lambda b: (b < "20") & ~b.isin("09", "0A", "0C", "0D")))
    return (
        F.when(F.exists(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), lambda b: b == "00"), "binary_content")
        .when(controls > F.floor(F.size(bytes_) / 10), "binary_content")
        .when(~F.call_function("is_valid_utf8", data), "invalid_encoding")
    )


def normal_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def safe_path(path: Column, depth: int = 32, chars: int = 240) -> Column:
    """The portable path of an archive member, null if it is not safe."""
    name = F.replace(path, F.lit("\\"), F.lit("/"))
    body = F.regexp_replace(name, "/$", "")
    parts = F.split(body, "/")
    bad = (name == "") | name.rlike(r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}]") | F.startswith(name, F.lit("/")) | name.rlike("^[A-Za-z]:") | F.contains(name, F.lit(":"))
    bad = bad | F.exists(parts, lambda p: p.isin("..", ".", "") | p.rlike(r"[ .]$")) | (F.size(parts) > depth) | (F.char_length(body) > chars)
    return F.when(~bad, body)


def normal_path(path: Column) -> Column:
    """The path without `.`, empty and `..` parts (`..` stays where nothing is left to drop); `.` if none is left."""
    step = lambda a, p: F.when(p.isin("", "."), a).when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))
    # element_at of an empty array is an error only where it is evaluated, so an anchor keeps it from being one
    kept = F.aggregate(F.split(path, "/"), F.array(F.lit("..")).cast("array<string>"), step)
    return F.transform(F.array(F.array_join(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), "/")), lambda p: F.when(p == "", ".").otherwise(p))[0]


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clipped(text: Column, most: int) -> Column:
    """Collapsed blanks; a longer text ends in three dots within the limit."""
    t = collapsed(text)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("...")))


def clipped_prose(text: Column, most: int, margin: int = 4) -> Column:
    """Prose within a limit: a text that was cut ends in an ellipsis at a word boundary."""
    t = collapsed(text)
    n = F.char_length(t)
    near = (n >= most - margin) & ~t.rlike("[.!?)`\"']$")
    bare = lambda c: F.regexp_replace(c, "[ ,;:-]+$", "")
    cut = F.substring(t, 1, most - 1)
    at = F.char_length(cut) - F.instr(F.reverse(cut), " ")
    words = F.when((F.instr(cut, " ") > 0) & (at >= most // 2), F.left(cut, at)).otherwise(cut)
    return F.when((n < most) & near, F.concat(bare(t), F.lit("…"))).when(n < most, t).otherwise(F.concat(bare(words), F.lit("…")))


#: A collation that knows neither case nor how accents are composed, and letters that case folding spells otherwise than it does.
CASELESS, SPELT = "UNICODE_CI", {"\u00df": "ss", "\u1e9e": "ss", "\u017f": "s"}


def caseless(text: Column) -> Column:
    """text as a key of joins, groups and comparisons that case and composition do not tell apart. Full-width forms equal plain ones."""
    for letter, spelling in SPELT.items():
        text = F.replace(text, F.lit(letter), F.lit(spelling))
    return F.collate(text, CASELESS)


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))


#: Weights of the token estimate, in hundredths of a token (fixed values): digits, line breaks and symbols; runs of blanks; other
#: characters by their bytes; long words for each letter; words up to 12 letters cost one token for each two and a half letters begun.
SIGN, BLANKS, WIDE, WIDEST, LONG_LETTER, LONG_WORD, BLANK_DIGIT, DENSE_SIGN, DENSE_RUN = 100, 15, 125, 200, 60, 12, 200, 100, 16
DENSE = r"[A-Za-z0-9+/=_\-]"


def without(text: Column, pattern: str) -> Column:
    """How many characters the matches of a pattern have."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def token_cost(text: Column) -> Column:
    """A cautious estimate of a text's tokens, summed in hundredths from counts of its letter runs, digits, blanks and signs.

    Runs of 16 or more letters, digits and joiners with both a letter and a digit cost 1 for each character; they part what stands
    around them. A single blank right before a digit costs a token of its own, any other run of blanks a little."""
    dense = rf"(?<!{DENSE})(?={DENSE}*[0-9])(?={DENSE}*[A-Za-z]){DENSE}{{{DENSE_RUN},}}+"
    count = lambda t, p: F.regexp_count(t, F.lit(p))
    words = [math.floor(2.5 * k) + 1 for k in range(math.ceil(LONG_WORD / 2.5))]  # from these lengths on a word costs one token more
    long = rf"[A-Za-z]{{{LONG_WORD + 1},}}+"

    def total(rest: Column) -> Column:
        other = F.regexp_replace(rest, r"[\x00-\x7f]+", "")
        short = F.lit(0)
        for k in words:
            short = short + count(rest, rf"[A-Za-z]{{{k},}}+")
        letters = SIGN * (short - len(words) * count(rest, long)) + LONG_LETTER * without(rest, long)
        signs = without(rest, r"[0-9\n\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+")
        blanks = BLANKS * count(rest, r"[ \t\r\f\x0B]+") + (BLANK_DIGIT - SIGN - BLANKS) * count(rest, r"(?<![ \t\r\f\x0B])[ \t](?=[0-9])")
        wide = WIDE * F.char_length(other) + (WIDEST - WIDE) * F.char_length(F.regexp_replace(other, "[^\\x{10000}-\\x{10FFFF}]+", ""))
        return letters + SIGN * signs + blanks + wide

    bound = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  (computes value once)
    runs = text.rlike(rf"{DENSE}{{{DENSE_RUN}}}")
    plain = bound(text, total)
    parted = bound(F.regexp_replace(text, dense, "\x00"), total) + DENSE_SIGN * without(text, dense)
    return F.ceil(F.when(runs, parted).otherwise(plain) / 100).cast("long")


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    third = F.concat(F.lit("5"), F.substring(h, 14, 3))
    fourth = F.concat(F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1)), F.substring(h, 18, 3))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), third, fourth, F.substring(h, 21, 12))
