"""Problem 3: records that differ only in whitespace, case, punctuation or field order.

Byte-identical rows collapse first (map-side, with counts); only the distinct survivors are canonicalised; the full
canonical texts are then grouped again and the counts summed.  A text travels once, to meet its copies; there its canonical text is
made, and from then on 256-bit digests of the whole texts stand for them.  No group is ever gathered into one task: every
aggregate keeps one smallest id and one count per key, and the membership of hot groups goes through broadcasts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archiveloom.session import settle

#: A name, a mark, a value.
FIELD = r"(?s)^\s*(\p{L}[^:=\n]{0,60}?)\s*[:=]\s*(\S.*?)\s*$"
LOOKS_LIKE_FIELDS = r"^[^\p{L}\p{N}]*\p{L}[^:=\n]{0,60}[:=]"
#: At most so many survivors can each hold more than this fraction of the rows, which bounds the broadcast.
HOT_KEYS = 10_000


def letters_and_digits(text: Column) -> Column:
    """The sequence of letters and digits, case aside ('ß' is 'ss', as its upper case is)."""
    return F.replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), F.lit("ß"), F.lit("ss"))


def field_set(text: Column) -> Column:
    """Canonical set of ``name: value`` fields, or null where the text isn't made up of such fields only.

    Fields are told apart by ``;`` or ``|`` (then line ends are plain space) or by line ends.
    """
    bare = F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")

    def fields(parts: Column) -> Column:
        parts = F.filter(parts, lambda p: F.length(F.trim(p)) > 0)
        whole = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(FIELD) & p.rlike(r"[:=].*[\p{L}\p{N}]"))
        one = lambda p: F.concat_ws("\u0001", letters_and_digits(F.regexp_extract(p, FIELD, 1)), letters_and_digits(F.regexp_extract(p, FIELD, 2)))
        return F.when(whole, F.array_join(F.array_sort(F.array_distinct(F.transform(parts, one))), "\u0002"))

    marked = F.when(bare.rlike(r"[;|]"), fields(F.split(F.regexp_replace(bare, r"[\r\n]+", " "), r"\s*[;|]\s*")))
    return F.when(text.rlike(LOOKS_LIKE_FIELDS), F.coalesce(marked, fields(F.split(bare, r"\s*[\r\n]+\s*"))))


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _survivors(df: DataFrame, key: str, text: str) -> DataFrame:
    raw = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    return raw.groupBy("t").agg(F.min("k").alias("first_id"), F.count("*").alias("n"))


def _canonical(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct raw text: the digests of it and of its canonical sequence, its field set, smallest id and number of copies."""
    made = _survivors(df, key, text).withColumn("seq", letters_and_digits(F.col("t"))).where("seq <> ''")
    return made.select(_digest(F.col("t")).alias("dt"), _digest(F.col("seq")).alias("ds"), field_set(F.col("t")).alias("card"), "first_id", "n")


def _sequences(canon: DataFrame) -> DataFrame:
    """Grouped on the canonical text; a sequence takes the field set of any of its spellings. ``spellings`` counts them."""
    seqs = canon.groupBy("ds").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"), F.max("card").alias("card"), F.count("*").alias("spellings"))
    return seqs.select("ds", F.coalesce(_digest(F.concat(F.lit("\u0003"), "card")), "ds").alias("dk"), "first_id", "n", "spellings")


def _sets(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy("dk").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("copies"), F.count("*").alias("sequences"))


def _placed(rows: DataFrame, table: DataFrame, key: str, times: str, bound) -> DataFrame:
    """``rows`` joined to ``table`` (unique in ``key``). Keys that ``times`` more rows than the bound have are looked up in a broadcast (there can be HOT_KEYS
    of them), all others meet in a shuffle."""
    hot = table.where(F.col(times) > bound).drop(times)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(times) <= bound).drop(times), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def collapse_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per set of equal records: ``keep_id`` (smallest key) and ``copies`` (all rows of the set).

    Null keys or texts, and texts without letters or digits, belong to no set.  Equal keys count as separate rows.
    Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    return _sets(_sequences(_canonical(df, key, text))).select("keep_id", "copies")


def duplicate_members(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (keep_id, copy_id): every member of a set but the kept one. Same cases as :func:`collapse_duplicates`."""
    # written once: from here on digests only are read
    canon = settle(_canonical(df, key, text))
    bound = canon.select(F.sum("n") / HOT_KEYS).first()[0] or 0.0
    seqs = settle(_sequences(canon))
    sets = _sets(seqs).where("copies > 1").drop("copies")
    kept = _placed(seqs.select("ds", "dk", "spellings"), sets, "dk", "sequences", bound).select("ds", "keep_id", "spellings")
    placed = settle(_placed(canon.select("dt", "ds", "first_id", "n"), settle(kept), "ds", "spellings", bound).select("dt", "first_id", "n", "keep_id"))
    firsts = placed.where("first_id <> keep_id").select("keep_id", F.col("first_id").alias("copy_id"))
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("copy_id"), _digest(F.col(text)).alias("dt"))
    exact = _placed(rows, placed.where("n > 1"), "dt", "n", bound)
    return firsts.unionByName(exact.where("copy_id <> first_id").select("keep_id", "copy_id"))
