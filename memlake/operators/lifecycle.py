"""Life cycles of documents and their stored artifacts, as guarded changes of state; indexing of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import text as X

#: States of an upload and what an event makes of them (fixed values); anything else is refused.
UPLOAD = {
    ("registered", "claim"): "blob_uploading",
    ("raw_storage_failed", "claim"): "blob_uploading",
    ("blob_uploading", "stored"): "blob_stored",
    ("blob_uploading", "pending"): "blob_pending",
    ("blob_uploading", "fail"): "raw_storage_failed",
    ("blob_pending", "promote"): "blob_available",
    ("blob_pending", "fail"): "raw_storage_failed",
}
ARTIFACT = {
    ("none", "put"): "putting",
    ("failed", "put"): "putting",
    ("putting", "done"): "stored",
    ("putting", "fail"): "failed",
    ("stored", "delete"): "deleting",
    ("deleting", "done"): "deleted",
    ("deleting", "fail"): "stored",
}


def apply_events(rows: DataFrame, events: DataFrame, key: str, legal: dict[tuple[str, str], str]) -> DataFrame:
    """rows with their state after one event each, compare-and-set: an event holds the attempt it is for.

    rows: key, state, attempt; events: key, event, attempt, one for each key.  An event of another
    attempt, or one that the state doesn't allow, changes nothing; a claim starts the next attempt.
    ``applied`` tells which happened.
    """
    moves = F.create_map(*[F.lit(x) for (state, event), new in legal.items() for x in (f"{state}/{event}", new)])
    e = events.select(key, F.col("event").alias("_event"), F.col("attempt").alias("_attempt"))
    out = rows.join(e, key, "left")
    new = F.when(F.col("_attempt") == F.col("attempt"), moves[F.concat_ws("/", "state", "_event")])
    out = out.withColumn("_new", new).withColumn("applied", F.col("_new").isNotNull())
    starts = F.col("applied") & F.col("_event").isin("claim", "put")
    return out.withColumn("attempt", F.col("attempt") + starts.cast("int")).withColumn("state", F.coalesce("_new", "state")).drop("_event", "_attempt", "_new")


def claim_batch(rows: DataFrame, due: Column, order: list[Column], size: int) -> DataFrame:
    """The first rows that are due, marked as claimed: what one run of a reconciler takes."""
    return rows.where(due).orderBy(*order).limit(size)


def upload_decision(state: Column, same_content: Column, has_uri: Column) -> Column:
    """What a repeated upload of the same content does; null if the content differs or the state allows nothing."""
    decided = (
        F.when(state.isin("blob_stored", "blob_pending", "blob_available"), "return_existing")
        .when((state == "blob_uploading") & has_uri, "finalize")
        .when(state.isin("blob_uploading", "raw_storage_failed"), "reclaim_and_upload")
    )
    return F.when(same_content, decided)


def final_state(stored: Column, provider: Column, eventual: tuple[str, ...] = ("filecoin",)) -> Column:
    return F.when(stored == "pending", "blob_pending").when(provider.isin(*eventual), "blob_available").otherwise("blob_stored")


def uri_parts(uri: Column, scheme: str = "mem://") -> Column:
    """(kind, id, as_of) of a resource address: memory/<id>, claim/<id>[@<time>] or a namespace; null for another scheme."""
    path = F.substring(uri, F.lit(len(scheme) + 1), F.length(uri))
    claim = F.regexp_extract(path, "^claim/(.*)$", 1)
    at = F.length(claim) - F.locate("@", F.reverse(claim)) + 1
    timed = claim.contains("@")
    kind = F.when(path.startswith("memory/"), "memory").when(path.startswith("claim/"), "claim").otherwise("directory")
    ident = F.when(kind == "memory", F.substring(path, F.lit(8), F.length(path))).when((kind == "claim") & timed, F.substring(claim, F.lit(1), at - 1)).when(kind == "claim", claim).otherwise(path)
    as_of = F.when((kind == "claim") & timed & (at < F.length(claim)), F.substring(claim, at + 1, F.length(claim)))
    return F.when(uri.startswith(scheme), F.struct(kind.alias("kind"), ident.alias("id"), as_of.alias("as_of")))


def slug(text: Column) -> Column:
    """Lower case letters and digits, other runs as one hyphen, none at the ends; null if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(out != "", out)


def index_documents(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, **sizes: int) -> DataFrame:
    """Chunks of the documents whose content is new or changed: (id, generation, chunk_index, ...), with the text's hash.

    known: (id, hash, generation), what is indexed; a document with the same hash is skipped, another's
    chunks get the next generation, which replaces the last (``replace_generation``).
    """
    hashed = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.sha2(text_col, 256).alias("hash"))
    seen = known.select("id", F.col("hash").alias("old"), "generation")
    due = hashed.join(seen, "id", "left").where(F.col("old").isNull() | (F.col("old") != F.col("hash")))
    due = due.select("id", "text", "hash", (F.coalesce("generation", F.lit(0)) + 1).alias("generation"))
    return X.chunks(due, "id", "text", **sizes).join(due.select("id", "hash", "generation"), "id")


def replace_generation(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Child rows: those of every key that ``new`` has come from there, all others stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_documents(documents: DataFrame, memories: DataFrame, gone: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Documents and memories after a soft delete of the documents in ``gone`` (document_id) and all memories made from them."""
    mark = gone.select("document_id").distinct().withColumn("_gone", F.lit(True))

    def marked(t: DataFrame) -> DataFrame:
        return t.join(mark, "document_id", "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_gone"), at))).drop("_gone")

    return marked(documents), marked(memories)
