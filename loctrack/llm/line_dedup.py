"""Line dedup by overlapping three-line windows (operator 9, native).

Every three consecutive lines of a text are hashed (MD5 of the lines).  Windows
found more than once anywhere in the corpus are repeats; the first in order of
(doc_id, position) stays as a whole, and the lines that later ones cover are
removed, unless the first of a repeat covers them in the same text.  Covered
positions of overlapping windows merge, so a repeated passage of n lines goes as
a whole, and one copy of every repeated window stays in the corpus.  Windows of nothing but white space don't count.  With
``edges``, a mark stands before the first and behind the last line, so that the
two lines at an edge, and texts of one or two lines, are windows as well; one or
two repeated lines between different neighbours are still not found.

DataFrame functions only.  Windows are counted with partial aggregation, so a
window in a third of all texts is a few rows; the join back to the windows and
the join to the texts can be split by AQE.  Texts are shuffled once.

Defined cases: a null text stays null, with 0 lines; texts of fewer than three
lines stay as they are without ``edges``; rows that repeat a doc_id with the same text count as
one document, so they are changed alike and don't remove each other's lines;
a null doc_id orders first; an empty table gives an empty result; other columns
are kept as they are.  Work and memory for a very long text are in proportion to
its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3
#: Stands for the lines outside a text; no line holds it.
EDGE = "\n"


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edges: bool = False) -> DataFrame:
    """(doc_id, text_hash, pos, hash) of every window with a word in it; with
    ``edges``, the first pos is -1."""
    text = F.col(f"`{text_col}`")
    split, edge = F.split(text, "\n"), F.array(F.lit(EDGE))
    lines = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), (F.concat(edge, split, edge) if edges else split).alias("lines")).where(F.size("lines") >= WINDOW)
    # shifted copies side by side: linear in the length of a text
    n = F.size("lines") - WINDOW + 1
    shifted = F.arrays_zip(*(F.slice("lines", k + 1, n).alias(f"l{k}") for k in range(WINDOW)))
    each = lines.select("doc_id", "text_hash", F.posexplode(shifted).alias("pos", "at")).withColumn("pos", F.col("pos") - int(edges))
    window = F.concat_ws("\n", *(F.col("at").getField(f"l{k}") for k in range(WINDOW)))
    return each.select("doc_id", "text_hash", "pos", window.alias("window")).where(F.col("window").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text_hash", "pos", F.unhex(F.md5("window")).alias("hash"))


def repeats(windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, later, firsts): positions of the windows that an
    earlier one of the corpus equals, and of the windows that later ones equal, in
    the documents that hold later ones."""
    place = F.struct("doc_id", "text_hash", "pos")
    first = windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hash", "first")
    later = windows.join(first, "hash").where(place != F.col("first")).select("doc_id", "text_hash", "pos", F.lit(True).alias("again"))
    both = later.unionByName(first.select("first.*", F.lit(False).alias("again")))
    return both.groupBy("doc_id", "text_hash").agg(*(F.collect_set(F.when(F.col("again") == again, F.col("pos"))).alias(name) for name, again in (("later", True), ("firsts", False)))).where(F.size("later") > 0)


def _covered(starts: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (WINDOW - 1)))))


def _without(lines: Column, places: Column) -> Column:
    """The lines but those at ``places``, which are in order."""
    low = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    high = F.concat(places, F.array(F.size(lines)))
    return F.flatten(F.zip_with(low, high, lambda a, b: F.slice(lines, a + 1, F.greatest(F.lit(0), b - a))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edges: bool = False, counts: bool = True) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text and, with
    ``counts``, the columns ``lines_before`` and ``lines_removed``, which replace
    columns of these names.  Rows travel packed, so others may have any names."""
    found = repeats(line_windows(docs, id_col, text_col, edges)).withColumnsRenamed({"doc_id": "in_id", "text_hash": "in_hash"})
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("doc") if len(docs.columns) > 1 else F.struct(F.lit(0)).alias("doc"), F.col(f"`{id_col}`").alias("key"), F.xxhash64(text).alias("key_hash"), F.split(text, "\n").alias("lines"))
    both = rows.join(found, rows.key.eqNullSafe(found.in_id) & (rows.key_hash == found.in_hash), "left")
    gone = F.filter(F.array_sort(F.array_except(_covered(F.col("later")), _covered(F.col("firsts")))), lambda p: (p >= 0) & (p < F.size("lines")))
    rest = both.withColumn("gone", gone).withColumn("kept", F.when(F.coalesce(F.size("gone"), F.lit(0)) <= 0, F.col("lines")).otherwise(_without(F.col("lines"), F.col("gone"))))
    n = F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines"))
    added = {"lines_before": n, "lines_removed": F.when(F.col("lines").isNull(), F.lit(0)).otherwise(n - F.size("kept"))} if counts else {}
    whole = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in added]
    return rest.select(*whole, *(c.alias(k) for k, c in added.items()))
