"""Secret scans by corpus-wide ownership frequency, DataFrame functions only.

Every text gives candidate secrets with their places.  Their values' hashes are
counted over the whole corpus by distinct repositories and distinct owners.  A
value looks live where at most ``MAX_OWNERS`` owners hold it, in at most
``MAX_REPOS`` repositories together, and it does not contain a stock word of
examples (``STOCK``); widely copied or stock values are examples.  The base
kinds (assign, access, hex) are always reported; spans of the further kind
("other": provider tokens, bearer tokens, key blocks, credentials in addresses)
only where the value looks live.

The counting is three aggregations with partial sums, first by (value, owner,
repository), so a value that stands in a third of all texts shuffles as few rows
as any other.  Its result is stored before it is joined back, so that the join
is between two plain exchanges, which Spark splits at a hot value.  Texts are
never shuffled.  Where the rows to mask are what was kept of a corpus, that corpus
can be given: owners of the copies that went still count.  Places are sums over blocks of a text's matches,
about as many blocks as a block has matches.

Nulls and edge cases: a null text is empty; a null owner or repository counts as
one more owner or repository; repeated rows are separate rows but one repository
if their repository values are equal; texts of any length and with any number of
candidates are taken whole; an empty table gives no rows; only the named columns
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

# Fixed values of the base kinds, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "other")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters and more
HEX = r"[0-9a-f]{24,}"

#: Further kinds of the method.
OTHER = (
    r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,64}@"
)
#: A value of more owners, or of more repositories, than these is an example.
MAX_OWNERS = 2
MAX_REPOS = 6
#: Words that only examples have in their values.
STOCK = r"(?i)example|sample|dummy|changeme|placeholder|redacted|xxxxxx|1234567|abcdefg"
MASK = "[SECRET]"
#: What the documents table tells of owners: a source; its texts in one language stand for one repository.
OWNER, REPOSITORY = "source", ("source", "lang")

_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def _ends(sizes: Column) -> Column:
    """Running sums of an array: within blocks of its length's root, and from block to block."""

    def running(own: Column, start: Column) -> Column:
        return F.slice(F.aggregate(own, F.array(start), lambda acc, x: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + x))), 2, F.size(own))

    def by_blocks(own: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(own))).cast("int")
        count = F.ceil(F.size(own) / width).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(own, i * width + 1, width))
        total = lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)
        return _let(
            blocks,
            lambda bs: F.flatten(
                F.zip_with(
                    bs,
                    F.concat(F.array(F.lit(0)), running(F.transform(F.slice(bs, 1, F.size(bs) - 1), total), F.lit(0))),
                    running,
                )
            ),
        )

    return _let(sizes, lambda own: F.when(F.size(own) > 0, by_blocks(own)).otherwise(F.array().cast("array<int>")))


def _found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern's matches: the pieces between them give the places."""
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), F.length)
    sizes = F.transform(whole, F.length)

    def spans(size: Column) -> Column:
        ends = _ends(F.zip_with(gaps, size, lambda a, b: a + b))
        both = F.zip_with(ends, size, lambda end, n: F.struct((end - n).alias("start"), end.alias("end")))
        return F.zip_with(
            both, values, lambda s, v: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), v.alias("value"))
        )

    placed = _let(sizes, spans).cast(f"array<{_SPAN}>")
    if least:
        placed = F.filter(placed, lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(f"array<{_SPAN}>"))


def candidates(text: Column) -> Column:
    """All spans of a text by start, then kind; values as md5 hashes, and whether they are stock examples."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(
        _found(text, ASSIGN, 0, group=1, least=ASSIGN_MIN), _found(text, ACCESS, 1), _found(text, HEX, 2), _found(text, OTHER, 3)
    )
    return F.transform(
        F.sort_array(found),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.md5(s["value"]).alias("value"), s["value"].rlike(STOCK).alias("stock")),
    )


def ownership(rows: DataFrame) -> DataFrame:
    """``value, n_repos, n_owners`` of every candidate of ``rows`` (spans, repo, owner)."""
    found = rows.select("repo", "owner", F.explode("spans").alias("s")).select("repo", "owner", F.col("s.value").alias("value"))
    return (
        found.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
        .groupBy("value", "owner").agg(F.count("*").alias("repos"))
        .groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))
    )


def _with_live(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Adds ``live``: for each span of a row, in order, whether its value looks live.  ``rows`` has row_id and is stored.

    ``more``: stored rows whose owners count too.  Distinct owners are counted, so rows may be in both.
    """
    own = rows.where(F.size("spans") > 0)
    counted = own if more is None else own.select("repo", "owner", "spans").unionByName(more.select("repo", "owner", "spans"))
    each = own.select("row_id", F.posexplode("spans").alias("k", "s")).select("row_id", "k", "s.value", "s.stock")
    held = table(ownership(counted), "secret-owners")
    live = ~F.col("stock") & (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repos") <= MAX_REPOS)
    judged = (
        each.join(held, "value")
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_list(F.struct("k", live.alias("live")))).alias("j"))
        .select("row_id", F.transform("j", lambda x: x["live"]).alias("live"))
    )
    return rows.join(judged, "row_id", "left").withColumn("live", F.coalesce("live", F.array().cast("array<boolean>")))


def _stored(docs: DataFrame, keep: list[Column], text_col: str, repo_cols: tuple[str, ...], owner_col: str) -> DataFrame:
    found = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.struct(*repo_cols).alias("repo"), F.col(owner_col).alias("owner"),
        *keep, candidates(F.col(text_col)).alias("spans"),
    )
    return table(found, "secrets")


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = REPOSITORY, owner_col: str = OWNER
) -> DataFrame:
    """One row per document: ``doc_id, spans, live`` (span: start, kind, end, value hash; reported spans only)."""
    rows = _with_live(_stored(docs, [F.col(id_col).alias("key")], text_col, repo_cols, owner_col))
    both = F.filter(F.arrays_zip("spans", "live"), lambda x: (x["spans"]["kind"] < 3) | x["live"])
    return rows.select(F.col("key").alias("doc_id"), both.alias("both")).select(
        "doc_id", F.transform("both", lambda x: x["spans"]).alias("spans"), F.transform("both", lambda x: x["live"]).alias("live")
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``MASK``."""
    state = "struct<at:int,out:string>"
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(state),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK)),
            ).otherwise(acc["out"]).alias("out"),
        ).cast(state),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_secrets(
    docs: DataFrame,
    text_col: str = "text",
    repo_cols: tuple[str, ...] = REPOSITORY,
    owner_col: str = OWNER,
    length_col: str | None = "n_chars",
    corpus: DataFrame | None = None,
) -> DataFrame:
    """The documents with the values that look live masked: a widely copied or stock example stays as it stands.

    ``corpus``: the documents whose owners count as well, with the same names of columns; none: ``docs`` alone.
    Only rows with candidates are joined.
    """
    columns = docs.columns
    rows = _stored(docs, [F.col(c).alias(f"c_{k}") for k, c in enumerate(columns)], text_col, repo_cols, owner_col)
    text = f"c_{columns.index(text_col)}"
    some = F.size("spans") > 0
    more = None if corpus is None else _stored(corpus, [], text_col, repo_cols, owner_col)
    # Stored, so that both sides of the join are plain and Spark knows their sizes.
    judged = table(_with_live(rows.select("row_id", "repo", "owner", "spans").where(some), more).select("row_id", "live"), "secret-verdicts")
    live = F.transform(F.filter(F.arrays_zip("spans", "live"), lambda x: x["live"]), lambda x: x["spans"])
    other = rows.where(some).join(judged, "row_id").withColumn("report", live).drop("live")
    out = rows.where(~some).withColumn("report", F.col("spans")).unionByName(other).withColumn(text, masked(F.col(text), F.col("report")))
    if length_col in columns:
        at = f"c_{columns.index(length_col)}"
        kind = docs.schema[length_col].dataType
        out = out.withColumn(at, F.when(F.size("report") > 0, F.length(text).cast(kind)).otherwise(F.col(at)))
    return out.select(*(F.col(f"c_{k}").alias(c) for k, c in enumerate(columns)))
