"""Secret scans: what looks like a credential, and how many owners have it.

Candidates are found by pattern. Each one's value is counted over the whole
corpus by its hash, by distinct repositories and owners. A value that many
owners have is a widely copied example; a live-looking one that few have is a
credential. For bare tokens, which no keyword or prefix gives away, that count
decides whether they're findings at all. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evlog.session import work_path

# The base patterns. The lengths of access and hex hold for a whole run of such characters, so they stand in the pattern.
WORDS = ("password", "passwd", "secret", "token")
ASSIGNED = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6  # characters of an assigned value
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

TOKEN = "[A-Za-z0-9+/_=-]{20,}"  # added by this operator
#: In the order in which findings with the same start are listed.
KINDS = ("assign", "access", "hex", "token")
DISTINCT = 8  # different characters, at least, of a live-looking value
FEW_OWNERS = 2  # a value that more owners have is an example


def any_case(word: str) -> str:
    """A pattern for an ASCII word in either case, which folds no other letter."""
    return "".join(f"[{c.upper()}{c}]" for c in word)


ASSIGN = f"({'|'.join([*map(any_case, WORDS), any_case('api') + '_?' + any_case('key')])}){ASSIGNED}"


def _live(kind: str, value: Column) -> Column:
    """Not a filler or a word: a digit and ``DISTINCT`` different characters; letters of both cases too in a bare token."""
    found = value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)
    return found & value.rlike("[a-z]") & value.rlike("[A-Z]") if kind == "token" else found


def _matches(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """The matches of a pattern from left to right, as (rank, gap, length, enough, live, digest): ``gap`` is the text before a match.

    Arrays are zipped, not indexed, so every regular expression runs once over a text.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)) if group else whole

    def row(gap: Column, hit: Column) -> Column:
        enough = F.length(hit["value"]) >= (ASSIGN_MIN if kind == "assign" else 0)
        return F.struct(F.lit(KINDS.index(kind)).alias("rank"), F.length(gap).alias("gap"), F.length(hit["whole"]).alias("length"), enough.alias("enough"),
                        _live(kind, hit["value"]).alias("live"), F.unhex(F.sha2(hit["value"].cast("binary"), 256)).alias("digest"))

    pairs = F.zip_with(whole, values, lambda w, v: F.struct(w.alias("whole"), v.alias("value")))
    rows = F.zip_with(F.split(text, pattern, -1), pairs, row)
    return F.when(text.rlike(pattern), F.filter(rows, lambda r: r["length"].isNotNull()))


def _blanked(text: Column, pattern: str) -> Column:
    """The text with spaces in place of the matches."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.zip_with(F.split(text, pattern, -1), whole,
                        lambda gap, match: F.concat(gap, F.coalesce(F.repeat(F.lit(" "), F.length(match)), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def _run(pattern: str) -> str:
    """The pattern, a character class and a count, tried only where a run of its characters begins."""
    return f"(?<!{pattern[:pattern.index(']') + 1]}){pattern}"


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str | Column = "source",
               repository: str | Column = "source") -> tuple[DataFrame, DataFrame]:
    """``(row, doc_id)`` for every document, and ``(row, owner, repository, kind, start, end, live, digest)`` for every candidate in them.

    Start and end are code points from 0, end exclusive. A candidate of kind ``token`` is a run
    outside the ``assign`` matches, and only live-looking ones are candidates.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*(F.coalesce(m, F.array().cast("array<struct<rank:int,gap:int,length:int,enough:boolean,live:boolean,digest:binary>>")) for m in (
        _matches(value, "assign", ASSIGN, 2), _matches(value, "access", ACCESS), _matches(value, "hex", _run(HEX)),
        _matches(_blanked(value, ASSIGN), "token", _run(TOKEN)))))
    as_column = [F.col(c) if isinstance(c, str) else c for c in (owner, repository)]
    folder = work_path(docs.sparkSession, "secrets-candidates")
    (docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), as_column[0].alias("owner"),
                 as_column[1].alias("repository"), found.alias("found")).write.parquet(folder))
    written = docs.sparkSession.read.parquet(folder)
    # The window is over one document's matches of one kind.
    upto = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (written.filter(F.size("found") > 0).select("row", "owner", "repository", F.posexplode("found").alias("at", "m")).select("row", "owner", "repository", "at", "m.*")
              .withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto)).filter("enough")
              .filter((F.col("rank") < KINDS.index("token")) | F.col("live")))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    return written.select("row", "doc_id"), placed.select("row", "owner", "repository", "rank", kind.alias("kind"),
                                                          (F.col("end") - F.col("length")).alias("start"), "end", "live", "digest")


def ownership(found: DataFrame) -> DataFrame:
    """``(digest, n_repositories, n_owners)`` of candidates: distinct repositories (of an owner) and owners; a null is one too.

    Each step is combined before its shuffle, so a value in a third of all documents is a row for each owner and task.
    """
    owned = found.select("digest", "owner", "repository").distinct().groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return owned.groupBy("digest").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str | Column = "source", repository: str | Column = "source",
         few: int = FEW_OWNERS) -> DataFrame:
    """``(doc_id, findings)``, a row for each document. Findings are in the order of their start, then of ``KINDS``:
    ``array<struct<start, rank, end, kind, n_repositories, n_owners, verdict>>``.

    The verdict on a value that more than ``few`` owners have is ``example``; otherwise ``live`` if it's
    live-looking (``_live``), else ``unclear``. All base matches are findings; a bare token is only with the verdict ``live``.
    Null and empty texts have no findings, and neither has a document without candidates. A repeated row is a document of
    its own but adds no owner; rows with one ``doc_id`` stay apart; null owners are one owner, null repositories of an owner one
    repository. Columns that aren't named are ignored. No rows in, no rows out.

    A document's findings meet in one task. Texts aren't shuffled, only hashes and places.
    """
    rows, found = candidates(docs, text, doc_id, owner, repository)
    spark = docs.sparkSession
    # Both sides of the join are written tables, so a digest that very many documents have can be split.
    paths = [work_path(spark, f"secrets-{x}") for x in ("placed", "owners")]
    found.write.parquet(paths[0])
    placed = spark.read.parquet(paths[0])
    ownership(placed).write.parquet(paths[1])
    verdict = F.when(F.col("n_owners") > few, "example").when(F.col("live"), "live").otherwise("unclear")
    judged = (placed.join(spark.read.parquet(paths[1]), "digest").withColumn("verdict", verdict)
              .filter((F.col("kind") != "token") | (F.col("verdict") == "live")))
    each = F.struct("start", "rank", "end", "kind", "n_repositories", "n_owners", "verdict")
    grouped = judged.groupBy("row").agg(F.sort_array(F.collect_list(each)).alias("findings"))
    none = F.array().cast(grouped.schema["findings"].dataType)
    return rows.join(grouped, "row", "left").select("doc_id", F.coalesce("findings", none).alias("findings"))


def spans(findings: Column) -> Column:
    """``kind:start:end``, with commas between."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
