"""Text functions as Column expressions, all on the JVM. Null in, null out, unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern of garbled text, that of a wiki title, and the rule of a table.
#: Five or more words of one or two letters in a row: a sign of bad recognition.
GARBLED = r"(?iU)(\b\w{1,2}\b\s*){5,}"
#: A first-level heading of a wiki line; '$' also before a final line end.
WIKI_TITLE = r"^\s* = [^=]* = \n?$"
TABLE_RULE = "|----------"
# A de-accenting table, letter for letter.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often and in whatever lambda ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at either end, of any Unicode kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_garbled(text: Column) -> Column:
    return text.rlike(GARBLED)


def sentences(text: Column) -> Column:
    """Sentences with their marks: a boundary is white space after '.', '?' or '!'."""
    return F.filter(F.split(text, r"(?<=[.?!])\s+"), lambda x: x != "")


def clean_text(text: Column) -> Column:
    """The sentences that aren't garbled, joined by spaces."""
    return F.array_join(F.filter(sentences(text), lambda x: ~is_garbled(x)), " ")


def occurs_often(text: Column, word: str) -> Column:
    """Whether a word stands more than twice as a whole, case aside."""
    return F.size(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: x == word.lower())) > 2


def split_sentences(text: Column, least: int = 1, pattern: str = r"[.?!]\n+") -> Column:
    """Pieces between the pattern's matches (which go), of at least so many characters."""
    return F.filter(F.split(text, pattern), lambda x: F.length(x) >= least)


def is_wiki_title(line: Column) -> Column:
    return line.rlike(WIKI_TITLE)


def paragraphs(text: Column) -> Column:
    """Parts of an article between its headings ('\\n =' goes)."""
    return F.split(text, "\n =")


def inline_headings(text: Column, to: str = " : ") -> Column:
    """Heading ends within the text replaced ('' joins a heading to its text)."""
    return F.replace(text, F.lit("= \n"), F.lit(to))


def title_language(title: Column) -> Column:
    """Language by a file's name: English by its marks, else French."""
    english = F.contains(title, F.lit("ENG")) | F.contains(title, F.lit("annual-report")) | F.contains(title, F.lit("-en-"))
    return F.when(english, "ENG").otherwise("FR")


def simple_tokens(text: Column, stop: list[str], least: int = 4) -> Column:
    """Lower-case words of 2 to 15 letters without accents, of at least ``least`` letters, that aren't stop words."""
    words = F.regexp_extract_all(F.lower(F.translate(text, ACCENTED, PLAIN)), F.lit(r"(?U)([\p{L}]+)"), F.lit(1))
    stops = F.array(*[F.lit(w) for w in sorted(set(stop))]) if stop else F.array().cast("array<string>")
    return F.filter(words, lambda w: (F.length(w) >= max(2, least)) & (F.length(w) <= 15) & ~F.array_contains(stops, w))


def topic_tokens(text: Column, stop: list[str]) -> Column:
    """Lower-case words of three letters or more that aren't stop words (the lemma is the word itself)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+)"), F.lit(1))
    stops = F.array(*[F.lit(w) for w in sorted(set(stop))]) if stop else F.array().cast("array<string>")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stops, w))


def ngrams(items: Column, n: int = 3) -> Column:
    """Sliding runs of n items; none if there are fewer."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.slice(items, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))


def titled_sections(text: Column) -> Column:
    """Sections as array<struct<pos, title, body>>: the text before the first heading has title '' (if not blank). A heading needs a
    line end on both sides. Of equal titles the last body stays, at the first one's place."""
    marked = F.regexp_replace(text, r"(?d)\n(#+ .+?)\n", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")  # the lambda below sees a part and its place only
    one = lambda p, i: F.struct(
        i.alias("pos"), F.when(i == 0, F.lit("")).otherwise(F.get(F.split(p, "\u0002"), F.lit(0))).alias("title"),
        strip(F.when(i == 0, p).otherwise(F.get(F.split(p, "\u0002", 2), F.lit(1)))).alias("body"),
    )

    def merged(rows: Column) -> Column:
        same = lambda s: F.filter(rows, lambda o: o["title"] == s["title"])
        firsts = F.filter(rows, lambda s: F.element_at(same(s), 1)["pos"] == s["pos"])
        return F.transform(firsts, lambda s: F.struct(s["pos"].alias("pos"), s["title"].alias("title"), F.element_at(same(s), -1)["body"].alias("body")))

    return let(F.filter(F.transform(parts, one), lambda s: ~((s["pos"] == 0) & (s["body"] == ""))), merged)


def dot_line_sections(text: Column, drop: str | None = None, longer_than: int = 100) -> Column:
    """Parts between lines of a single dot, longer than so many characters after stripping, in lower case.

    ``drop``: a pattern whose matches go first.
    """
    parts = F.split(text, "\n\\.\n")
    if drop:
        parts = F.transform(parts, lambda x: F.regexp_replace(x, drop, ""))
    parts = F.filter(F.transform(parts, strip), lambda x: F.length(x) > longer_than)
    return F.transform(parts, F.lower)


def response_text(text: Column) -> Column:
    """A model's answer without its role mark."""
    return strip(F.regexp_replace(text, r"^assistant:\s*", ""))


def bulletless_questions(text: Column, most: int) -> Column:
    """Lines that end in '?', without their numbering, not empty, the first so many."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.endswith(x, F.lit("?")))
    lines = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^\d+[).\s]", ""))), lambda x: x != "")
    return F.slice(lines, 1, most)
