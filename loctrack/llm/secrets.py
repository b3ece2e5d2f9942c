"""Secret scans with corpus-wide ownership frequency (operator 10, native).

Base spans come from three fixed patterns.  The method adds candidates that no
base pattern names: long runs that mix letters and digits.  All candidates are
hashed, and the corpus says by how many distinct owners and repositories each
hash is held.  A candidate of at most ``MAX_OWNERS`` owners and ``MAX_REPOS``
repositories looks like a live credential of its owner and, if no base span holds
it, adds a span of kind ``owned``; one that more owners or repositories hold is a
widely copied example.  A repository belongs to its owner: equal names under two
owners are two repositories.

DataFrame functions only; positions follow from the lengths of the pieces
between the matches, in code points, as running sums over the rows of a text's
matches, and overlaps from one pass over them in order; both take time in
proportion to the matches, but for their sort.  Texts are scanned once and never
shuffled: behind the scan come rows of spans.  Owners are counted over distinct
(hash, owner, repository) rows, with partial aggregation, so a candidate in a
third of all texts is a few rows for each task.

Defined cases: a null or empty text has no spans; a null owner or repository
counts as one of its own; rows that repeat a doc_id are each returned; an empty
table gives an empty result; other columns are not read.  The matches of one text
meet in one task, its text in none but the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loctrack.llm.common import written

#: Owners up to which a candidate looks like a live credential.
MAX_OWNERS = 2
#: Repositories up to which it does; a single owner may hold an example in more.
MAX_REPOS = 3
#: Kinds in the order of listing; pattern, group of the value, least length of it.
KINDS = ("assign", "access", "hex", "owned")
PATTERNS = (
    (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a shorter match of these two always ends where its run ends, so the least
    # length may stand in the pattern
    (r"AKIA[A-Z0-9]{16,}", 0, 20),
    (r"[0-9a-f]{24,}", 0, 24),
    (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", 0, 20),
)


def _pieces(text: Column, kind: int) -> Column:
    """For each match of a kind: what precedes it since the last one, its length,
    that of its value, and the MD5 of the value."""
    pattern, group, _ = PATTERNS[kind]
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.transform(
        F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value")),
        lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(p["gap"]).alias("gap"), F.length(p["whole"]).alias("whole"), F.length(p["value"]).alias("value"), F.md5(p["value"].cast("binary")).alias("hash")),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,whole:int,value:int,hash:string>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols: tuple[str, ...] = ("source",), repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(row, doc_id, owner, repo, pieces) for every row of ``docs``, written once."""
    key = lambda cols: F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols)))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), key(owner_cols).alias("owner"), key(repo_cols).alias("repo"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", F.concat(*(_pieces(F.col("text"), k) for k in range(len(KINDS)))).alias("pieces")), "secrets")


def spans(found: DataFrame) -> DataFrame:
    """(row, owner, repo, start, kind, end, hash) of every candidate: base spans,
    and the others that overlap no base span of their row.

    Places are running sums over a row's pieces.  For the overlaps one pass over
    the borders in order is enough: a base span that starts before a candidate
    ends overlaps it if the furthest end of such spans lies behind its start."""
    each = found.select("row", "owner", "repo", F.explode("pieces").alias("p")).select("row", "owner", "repo", "p.*")
    along = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.element_at(F.array(*(F.lit(n) for _, _, n in PATTERNS)), F.col("kind") + 1)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("whole")).over(along).cast("int")).withColumn("start", F.col("end") - F.col("whole")).where(F.col("value") >= least)
    base = F.col("kind") < len(KINDS) - 1
    borders = Window.partitionBy("row").orderBy("border", base).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = placed.withColumn("border", F.when(base, F.col("start")).otherwise(F.col("end"))).withColumn("reach", F.max(F.when(base, F.col("end"))).over(borders))
    return reach.where(base | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).select("row", "owner", "repo", "start", "kind", "end", "hash")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) of every candidate."""
    each = candidates.select("hash", "owner", "repo")
    of_repo = each.distinct()
    of_owner = of_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n_repos"))
    return of_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos"))


def _text(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols: tuple[str, ...] = ("source",), repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(doc_id, base, base_text, spans, n_live, n_example, candidates) for every
    row: base spans as an array and as text, all spans as text, how many of all
    candidates look live or are widely copied, and all candidates with their
    numbers of owners and repositories."""
    found = scan(docs, id_col, text_col, owner_cols, repo_cols)
    each = written(spans(found), "candidates")
    told = each.join(ownership(each), "hash").select("row", "start", "kind", "end", "hash", "n_owners", "n_repos", ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).alias("live"))
    shown = F.col("live") | (F.col("kind") < len(KINDS) - 1)
    by_row = told.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(shown, F.struct("start", "kind", "end")))).alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("kind") < len(KINDS) - 1, F.struct("start", "kind", "end", "hash")))).alias("base"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_example"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repos"))).alias("candidates"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    base = F.coalesce("base", F.array().cast("array<struct<start:int,kind:int,end:int,hash:string>>"))
    return found.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", base.alias("base"), _text(base).alias("base_text"), F.coalesce(_text(F.col("all")), F.lit("")).alias("spans"), zero("n_live"), zero("n_example"), "candidates")
