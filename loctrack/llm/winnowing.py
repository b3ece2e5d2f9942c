"""Document fingerprints by winnowing (operator 12), in Spark functions only.

A text is read as pieces: runs without white space, cut after every ``PIECE``
code points.  The hash of each ``GRAM`` consecutive pieces rolls over the text;
of each ``WINDOW`` consecutive hashes the least is kept, the rightmost among
equals, with its place.  Every run of ``GRAM + WINDOW - 1`` pieces that two texts
share therefore leaves a common hash in both fingerprints, and no shared run of
fewer than ``GRAM`` pieces does.

Hash and place are one number, 31 bits of the hash above the complement of the
place, so that the least number is the rightmost least hash; the least of a
window comes from doubling steps over whole arrays, linear in the text.

Defined cases: a null text counts as empty, and a text without any piece has an
empty fingerprint; a text of fewer pieces than a gram is one gram, one of fewer
hashes than a window is one window.  Two empty fingerprints are alike (1), an
empty and another are not (0).  Rows that repeat an id and a text are one
document for the order, and each of them is returned; documents that share an id
follow each other by the hash of the text; a null id comes last.  The next of
the only document is itself.  An empty table gives an empty result; other columns
are not read.  A very long text costs time and memory in proportion to its length:
its grams and their numbers, some forty times its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loctrack.llm.common import keyed
from loctrack.llm.ordering import ranked

PIECE = 8
GRAM = 4
#: A power of two.
WINDOW = 8
#: Documents that look for their next one in one group.
BLOCK = 64
#: What tells documents apart, without nulls.
KEY = ["no_id", "id_text", "hash"]
#: Copies of a document that are returned by one task.
COPIES = 1000

_SPACE, _LETTER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def grams(text: Column, gram: int = GRAM, piece: int = PIECE) -> Column:
    """The runs of ``gram`` pieces, each from its first piece on."""
    one = f"{_LETTER}{{1,{piece}}}+"
    runs = F.regexp_extract_all(text, F.lit(f"(?=((?:{one}{_SPACE}*+){{{gram - 1}}}{one})){one}"), F.lit(1))
    return F.when(F.size(runs) > 0, runs).when(text.rlike(_LETTER), F.array(F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")))


def packed(text: Column, gram: int = GRAM, piece: int = PIECE) -> Column:
    """A number for each gram: hash above, complement of the place below."""
    return F.transform(grams(text, gram, piece), lambda g, i: F.xxhash64(g).bitwiseAND(F.lit(0x7FFFFFFF00000000)).bitwiseOR(F.lit(0xFFFFFFFF) - i))


def with_fingerprint(df: DataFrame, text: Column, name: str, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """``df`` with ``name``: the kept numbers of the text, by place."""
    df, step = df.withColumn(name, packed(text, gram, piece)), 1
    size = F.size(name)
    df = df.withColumn(f"{name}_n", F.greatest(F.lit(1), size - (window - 1)))
    while step < window:  # least of 2, 4, 8... hashes from each on
        df = df.withColumn(name, F.zip_with(name, F.slice(F.col(name), step + 1, F.greatest(F.lit(1), size)), lambda a, b: F.least(a, b)))
        step *= 2
    return df.withColumn(name, F.coalesce(F.array_distinct(F.slice(F.col(name), F.lit(1), F.col(f"{name}_n"))), F.array().cast("array<bigint>"))).drop(f"{name}_n")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32)))


def places(fingerprint: Column) -> Column:
    """(hash, place) of each kept gram."""
    return F.transform(fingerprint, lambda x: F.struct(F.shiftright(x, 32).alias("hash"), (F.lit(0xFFFFFFFF) - x.bitwiseAND(F.lit(0xFFFFFFFF))).alias("place")))


def as_text(fingerprint: Column) -> Column:
    """hash:place of each kept gram, hexadecimal, by place, comma-joined."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(":", F.lower(F.hex(F.shiftright(x, 32))), F.lower(F.hex(F.lit(0xFFFFFFFF) - x.bitwiseAND(F.lit(0xFFFFFFFF)))))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _order(rows: DataFrame) -> DataFrame:
    """(no_id, id_text, hash, copies, place) of the distinct documents."""
    keys = rows.groupBy(*KEY).agg(F.count("*").alias("copies"), F.first("id").alias("id"))
    return ranked(keys, [F.col("id").desc_nulls_last(), F.col("hash").asc()], "place").drop("id")


def _with_next(rows: DataFrame, order: DataFrame, n_docs: int, gram: int, window: int, piece: int, block: int, only: DataFrame | None = None) -> DataFrame:
    """(id, text, copies, place, fp, next_text, next_fp) of every distinct
    document, or of the blocks of ``only`` (block)."""
    whole = rows.groupBy(*KEY).agg(F.first("id").alias("id"), F.first("text").alias("text"))
    placed = whole.join(order, KEY)  # grouped by the same columns: texts are not shuffled again
    # a block ends with a copy of the document that follows its last
    own = F.struct(F.floor(F.col("place") / block).alias("block"), F.col("place").alias("place"), F.lit(True).alias("own"))
    after = F.when(F.col("place") == 0, F.lit(n_docs)).when(F.col("place") % block == 0, F.col("place"))
    edge = F.when(after.isNotNull(), F.struct(F.floor((after - 1) / block).alias("block"), after.alias("place"), F.lit(False).alias("own")))
    dealt = placed.select("id", "text", "copies", F.explode(F.array_compact(F.array(own, edge))).alias("at")).select("id", "text", "copies", "at.*")
    if only is not None:
        dealt = dealt.join(only, "block", "left_semi")
    printed = with_fingerprint(dealt.repartition("block"), F.col("text"), "fp", window, gram, piece)
    following = Window.partitionBy("block").orderBy("place", F.col("own").desc())
    return printed.withColumn("next_text", F.lead("text").over(following)).withColumn("next_fp", F.lead("fp").over(following)).where("own").drop("own")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, piece: int = PIECE, block: int = BLOCK, copies: int = COPIES) -> DataFrame:
    """(id, n_chars, fp, edited, edited_fp, near_edited, near_next) for every row;
    the next document is by descending id, that of the last is the first, and the
    edited text ends with the next one's beginning instead of its own half."""
    rows = keyed(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = rows.withColumn("no_id", F.col("id").isNull()).withColumn("id_text", F.coalesce(F.col("id").cast("string"), F.lit("")))
    order = _order(rows)
    n_docs = order.count()

    def compared(only: DataFrame | None = None) -> DataFrame:
        found = _with_next(rows, order, n_docs, gram, window, piece, block, only).withColumn("n_chars", F.length("text").cast("bigint"))
        half = F.floor(F.col("n_chars") / 2).cast("int")
        found = found.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
        found = with_fingerprint(found, F.col("edited"), "edited_fp", window, gram, piece).withColumn("own_set", hashes(F.col("fp")))
        return found.withColumn("near_edited", likeness(F.col("own_set"), hashes(F.col("edited_fp")))).withColumn("near_next", likeness(F.col("own_set"), hashes(F.col("next_fp"))))

    out = ["id", "n_chars", "fp", "edited", "edited_fp", "near_edited", "near_next"]
    repeated = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    found = compared().where(F.col("copies") <= copies).withColumn("copy", repeated)
    hot = order.where(F.col("copies") > copies).select(F.floor(F.col("place") / block).alias("block")).distinct()
    if hot.isEmpty():
        return found.select(out)
    # a document of very many copies is dealt out before it is repeated
    parts = compared(hot).where(F.col("copies") > copies).withColumn("part", F.explode(F.sequence(F.lit(1), F.ceil(F.col("copies") / copies)))).repartition("place", "part")
    parts = parts.withColumn("copies", F.least(F.lit(copies), F.col("copies") - copies * (F.col("part") - 1))).withColumn("copy", repeated)
    return found.select(out).unionByName(parts.select(out))
