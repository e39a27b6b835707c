"""The document catalog of connectors: formats, scopes, pages, index status, counts.

Documents have id, connector_id, source_uri, etag, status, reason, mime_type, size_bytes,
index_fingerprint, index_status and run_id.  Every function is a filter, one aggregation
or a rewrite by an expression over them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.lifecycle import FINAL

OFFICE = "application/vnd.openxmlformats-officedocument."
#: Media types of each format kind, and of code.
KINDS: dict[str, tuple[str, ...]] = {
    "pdf": ("application/pdf",),
    "docx": (f"{OFFICE}wordprocessingml.document",),
    "pptx": (f"{OFFICE}presentationml.presentation",),
    "xlsx": (f"{OFFICE}spreadsheetml.sheet",),
    "markdown": ("text/markdown",),
    "html": ("text/html",),
    "csv": ("text/csv", "text/tab-separated-values"),
    "json": ("application/json", "application/x-ndjson"),
    "text": ("text/plain",),
    "code": (
        "text/x-rst", "application/yaml", "application/xml", "text/x-python", "text/javascript", "text/x-typescript", "text/x-tsx", "text/x-jsx", "text/x-go", "text/x-java",
        "text/x-ruby", "text/x-rust", "application/sql", "application/x-sh", "text/x-c", "text/x-c++", "text/x-csharp", "text/x-php", "text/x-kotlin", "text/x-swift", "application/toml",
    ),
}
PROSE = ("markdown", "text", "html", "pdf", "docx", "pptx")


def format_label(mime_type: Column) -> Column:
    """The kind of a media type; `other` for what is unknown or null."""
    known = F.create_map(*(F.lit(x) for kind, types in KINDS.items() for t in types for x in (t, kind)))
    return F.coalesce(F.try_element_at(known, F.coalesce(mime_type, F.lit(""))), F.lit("other"))


def of_kind(kind: str) -> Column:
    """Documents of one format kind, as a condition on mime_type alone, so that it reaches the scan."""
    mime = F.col("mime_type")
    if kind == "other":
        return mime.isNull() | ~mime.isin(sorted(t for types in KINDS.values() for t in types))
    return mime.isin(sorted(KINDS.get(kind, ()))) if kind in KINDS else F.lit(False)


def in_scope(scope: str, formats: Sequence[str] = (), run_id: int | None = None) -> Column:
    """Documents that a reprocessing of `scope` takes: stale, formats, unrecorded, failed or all."""
    if scope == "stale":
        return F.col("index_status") == "stale"
    if scope == "formats":
        out = F.lit(False)
        for kind in sorted(formats):
            out |= of_kind(kind)
        return out
    if scope == "unrecorded":
        return (F.col("status") == "indexed") & F.col("index_fingerprint").isNull()
    if scope == "failed":
        out = (F.col("status") == "failed") & (F.col("reason").isNull() | (F.col("reason") != "missing_object"))
        return out if run_id is None else out & (F.col("run_id") == run_id)
    return F.lit(True)


def page(rows: DataFrame, key: str, limit: int, after: int | None = None, newest_first: bool = True) -> DataFrame:
    """A keyset page: `limit` rows past `after`, and as next_cursor the last one's key if there are more, else null.

    One row more than the page is read, so no count is needed; the order is a distributed top-n.
    """
    if after is not None:
        rows = rows.where(F.col(key) < after if newest_first else F.col(key) > after)
    order = F.desc(key) if newest_first else F.asc(key)
    more = rows.orderBy(order).limit(limit + 1)
    # At most limit + 1 rows: one small window.
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    place, n = F.row_number().over(w).alias("_place"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("_n")
    placed = more.select("*", place, n)
    last = F.max(F.when(F.col("_place") == limit, F.col(key))).over(Window.partitionBy(F.lit(0)))
    return placed.withColumn("next_cursor", F.when(F.col("_n") > limit, last)).where(F.col("_place") <= limit).drop("_place", "_n")


def documents_in_scope(documents: DataFrame, connector_id: int, scope: Column, limit: int, after: int | None = None) -> DataFrame:
    """A page of a connector's documents in a final state that the scope takes, ascending by id."""
    rows = documents.where((F.col("connector_id") == connector_id) & F.col("status").isin(*FINAL) & scope)
    return page(rows, "id", limit, after, newest_first=False)


def document_page(documents: DataFrame, connector_id: int, limit: int, after: int | None = None, status: str | None = None, index_status: str | None = None) -> DataFrame:
    rows = documents.where(F.col("connector_id") == connector_id)
    for name, value in (("status", status), ("index_status", index_status)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return page(rows, "id", limit, after)


def unfinished_for_run(documents: DataFrame, run_id: int) -> DataFrame:
    return documents.where((F.col("run_id") == run_id) & ~F.col("status").isin(*FINAL))


def index(documents: DataFrame, connector_id: int) -> DataFrame:
    """What a resync must know of a connector's documents."""
    return documents.where(F.col("connector_id") == connector_id).select("id", "source_uri", "etag", "status")


def audit_rows(documents: DataFrame, connector_id: int) -> DataFrame:
    return documents.where(F.col("connector_id") == connector_id).select("id", "source_uri", "mime_type", "size_bytes", "status", "index_fingerprint")


def reconciled_status(documents: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Documents with index_status current or stale by the fingerprint expected of their kind, and whether that is a change.

    Documents that aren't indexed, have no fingerprint or are being reprocessed stay as they are, and so do kinds nothing is expected of.
    """
    wanted = F.lit(None).cast("string")
    for kind, fingerprint in sorted(expected.items()):
        now = F.when(F.col("index_fingerprint") == fingerprint, "current").otherwise("stale")
        wanted = F.when(of_kind(kind), now).otherwise(wanted)
    open_ = (F.col("status") == "indexed") & F.col("index_fingerprint").isNotNull() & (F.col("index_status") != "reprocessing")
    changed = F.coalesce(open_ & (F.col("index_status") != wanted), F.lit(False))
    return documents.withColumn("changed", changed).withColumn("index_status", F.when(changed, wanted).otherwise(F.col("index_status")))


def digest(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)


def with_embedding_model(fingerprint: Column, model: Column) -> Column:
    """The fingerprint under another embedding model; one that can't be read stays as it is."""
    names = F.array_sort(F.transform(F.split(fingerprint, ";"), lambda s: F.substring_index(s, "=", 1)))
    readable = names == F.array(*(F.lit(n) for n in sorted(("em", "tk", "ch", "sm", "xv"))))
    return F.when(readable, F.regexp_replace(fingerprint, F.lit("(^|;)em=[^;]*"), F.concat(F.lit("$1em="), digest(model)))).otherwise(fingerprint)


def stale_connectors(documents: DataFrame, connectors: DataFrame) -> DataFrame:
    """Connectors with documents that are stale or being reprocessed, and how many."""
    count = lambda s: F.count_if(F.col("index_status") == s)
    tally = documents.groupBy("connector_id").agg(count("stale").alias("stale"), count("reprocessing").alias("reprocessing"))
    return connectors.join(tally.where("stale > 0 or reprocessing > 0"), "connector_id")


def status_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("connector_id", "status").agg(F.count("*").alias("documents"))


def indexed_by_format(documents: DataFrame) -> DataFrame:
    """Indexed documents by kind: counted by media type first, so that few rows are folded to kinds."""
    by_type = documents.where("status = 'indexed'").groupBy("connector_id", "mime_type").agg(F.count("*").alias("n"))
    return by_type.groupBy("connector_id", format_label(F.col("mime_type")).alias("kind")).agg(F.sum("n").alias("documents"))


def stale_mime_types(documents: DataFrame) -> DataFrame:
    return documents.where("index_status = 'stale'").select("connector_id", "mime_type").distinct()


def organization_bytes(documents: DataFrame) -> DataFrame:
    return documents.groupBy("organization_id").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def connector_chunkings(connectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Connectors that aren't being deleted, with how many documents they have indexed (0 for none)."""
    tally = documents.where("status = 'indexed'").groupBy("connector_id").agg(F.count("*").alias("n"))
    rows = connectors.where("status <> 'deleting'").join(tally, "connector_id", "left")
    return rows.select("connector_id", "chunking", F.coalesce("n", F.lit(0)).alias("indexed_documents"))


def estimated_tokens(chunks: Column, chunk_size: Column, size_bytes: Column) -> Column:
    """What reprocessing a document costs: chunks times their size, or a quarter of its bytes if it has none."""
    return F.when(chunks > 0, chunks * chunk_size).otherwise(F.floor(size_bytes / 4))


def audit_events(events: DataFrame, limit: int, after: int | None = None, start: str | None = None, end: str | None = None, **equal) -> DataFrame:
    """A page of audit events, newest first; every filter is optional and only narrows."""
    for name, value in equal.items():
        events = events if value is None else events.where(F.col(name) == value)
    at = F.col("created_at")
    if start is not None:
        events = events.where(at >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.where(at < F.lit(end).cast("timestamp_ntz"))
    return page(events, "id", limit, after)


def like_escaped(text: str) -> str:
    """Text as a literal part of a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def users_page(users: DataFrame, limit: int, after: int | None = None, search: str | None = None) -> DataFrame:
    if search:
        users = users.where(F.lower("external_id").like(f"%{like_escaped(search.lower())}%"))
    return page(users, "id", limit, after)


def users_with_facts(users: DataFrame, counts: DataFrame) -> DataFrame:
    """Users of a page with their live facts' number, 0 for none."""
    return users.join(counts, users["id"] == counts["end_user_id"], "left").select(*(users[c] for c in users.columns), F.coalesce("facts", F.lit(0)).alias("facts"))


def referencing(targets: DataFrame, model_id: int) -> DataFrame:
    """Gateways with a target on a model, each once."""
    return targets.where(F.col("model_id") == model_id).select("gateway_id").distinct()


def settings_with_editor(settings: DataFrame, users: DataFrame) -> DataFrame:
    """Settings and who edited them last; a name is null where the editor is unknown."""
    return settings.join(users.select(F.col("id").alias("updated_by"), F.col("name").alias("editor")), "updated_by", "left").select("key", "value", "editor")


def purge(table: DataFrame, organization_id: int) -> tuple[DataFrame, DataFrame]:
    """What stays of a table when an organization goes, and how many rows go."""
    gone = F.col("organization_id") == organization_id
    return table.where(~gone | F.col("organization_id").isNull()), table.where(gone).agg(F.count("*").alias("removed"))
