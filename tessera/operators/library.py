"""The document library: one row for each document, with tags and metadata, and how it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays, text
from tessera.storage import stored

#: What one page of results may ask for.
LIMITS = (1, 200)


def from_documents(documents: DataFrame, labels: DataFrame | None = None, content_type: Column | None = None) -> DataFrame:
    """The library of a table of documents: a file for each, its language and source as tags, its labels as metadata; its content type is General where none is given.

    Documents without labels have null values in their metadata, as a library has where a key is missing.
    """
    rows = documents.select(
        F.col("doc_id"),
        F.format_string("DOC-%06d", "doc_id").alias("id"),
        F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.lit("txt").alias("file_type"),
        text.content_type(content_type if content_type is not None else F.lit(None).cast("string")).alias("content_type"),
        F.col("source"),
        F.substring("text", 1, 200).alias("digest"),
        F.array("lang", "source").alias("tags"),
        text.text_hash(F.col("text")).alias("content_hash"),
        F.col("text"),
    )
    if labels is not None:
        rows = rows.join(labels, "doc_id", "left").withColumn("metadata", F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string"))).drop("quality", "toxic")
    return rows


def filter_documents(library: DataFrame, *, file_type: str | None = None, content_type: str | None = None, tags: str | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """Documents of a file type, a content type (null counts as General), any of the comma-separated tags, and all of the metadata values."""
    out = library
    if file_type:
        out = out.where(F.col("file_type") == file_type)
    if content_type:
        wanted = text.CONTENT_TYPES.get(content_type.strip().lower())
        if wanted is None:
            raise ValueError(f"unknown content type: {content_type}")
        out = out.where(F.lower(F.coalesce("content_type", F.lit("General"))) == wanted.lower())
    if tags and (names := [t.strip() for t in tags.split(",") if t.strip()]):
        out = out.where(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, names))), F.lit(False)))
    for key, expected in (metadata or {}).items():
        out = out.where(arrays.metadata_matches(F.col("metadata"), key, expected))
    return out


def upsert(library: DataFrame, changes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The library with each key's row of the highest version. Both tables have the same columns."""
    latest = Window.partitionBy(key).orderBy(F.col(version).desc())
    return library.unionByName(changes).withColumn("_place", F.row_number().over(latest)).where("_place = 1").drop("_place")


def delete(library: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return library.join(gone.select(key).distinct(), key, "left_anti")


def guarded_update(library: DataFrame, changes: DataFrame, columns: list[str], key: str = "id", generation: str = "generation") -> DataFrame:
    """Take the changed columns of those changes that were made against the generation that the library still has; stale ones are left out."""
    new = changes.select(key, F.col(generation).alias("_generation"), *(F.col(c).alias(f"_{c}") for c in columns))
    current = F.col(generation) == F.col("_generation")
    joined = library.join(new, key, "left")
    return joined.select(*(F.when(current, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in library.columns))


def generation(content_hash: Column, filename: Column, tags: Column, metadata: Column, source: Column) -> Column:
    """A token that changes when the content, name, tags, metadata or source of a document do."""
    pairs = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(arrays.json_string(e["key"]), F.lit(": "), F.coalesce(arrays.json_string(e["value"]), F.lit("null"))))
    return F.sha2(arrays.python_json({
        "content_hash": arrays.json_string(content_hash), "filename": arrays.json_string(filename), "source": arrays.json_string(source),
        "tags": F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(tags), arrays.json_string), ", "), F.lit("]")),
        "metadata": F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")),
    }), 256)


def content_groups(documents: DataFrame, body: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document with the latest one of the same content, and how often that content comes. An empty text is never a copy.

    Documents meet by hash only as partial aggregates and in a join that Spark can split where a content is frequent.
    """
    rows = documents.select(key, text.text_hash(F.col(body)).alias("content_hash"), (F.coalesce(F.length(body), F.lit(0)) > 0).alias("_some"))
    groups = rows.where("_some").groupBy("content_hash").agg(F.max(key).alias("latest"), F.count(F.lit(1)).alias("copies"))
    joined = rows.join(groups, ["content_hash"], "left")
    return joined.select(key, "content_hash", F.when(F.col("_some"), F.col("latest")).otherwise(F.col(key)).alias("latest"), F.when(F.col("_some"), F.col("copies")).otherwise(F.lit(1)).alias("copies"))


def merge_tags(captures: DataFrame, by: str, tags: str = "tags") -> DataFrame:
    """The sorted union of all tags of each group."""
    return captures.select(by, F.explode_outer(tags).alias("_tag")).groupBy(by).agg(F.array_sort(F.collect_set("_tag")).alias("tags"))


def numbered_ids(new: DataFrame, existing: DataFrame, order: list[str], prefix: str = "DOC", key: str = "id") -> DataFrame:
    """Ids such as DOC-007 for new rows in their order, beyond the highest number that is taken.

    Rows are numbered within range partitions, which are stored so that both readings see the same ones; their counts
    alone are added up in one place.
    """
    taken = existing.select(F.regexp_extract(key, rf"^{prefix}-([0-9]+)$", 1).alias("n")).where("n <> ''").agg(F.coalesce(F.max(F.col("n").cast("long")), F.lit(0)).alias("_base"))
    ranged = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("_part", F.shiftright("_at", 33)), "numbered")
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = parts.select("_part", (F.sum("_n").over(Window.partitionBy().orderBy("_part")) - F.col("_n")).alias("_start"))
    numbered = ranged.join(F.broadcast(starts), "_part").crossJoin(F.broadcast(taken))  # a row for each partition; one row
    number = F.col("_base") + F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.withColumn(key, F.format_string(f"{prefix}-%03d", number)).drop("_at", "_part", "_start", "_base")


def filename_ids(new: DataFrame, existing: DataFrame, filename: str = "filename", order: str = "filename", key: str = "id") -> DataFrame:
    """Ids from file names. A name that comes again, or is taken, gets the next of -2, -3 and so on after the highest that is taken."""
    based = new.withColumn("_base", text.document_id(F.col(filename)))
    whole = existing.select(F.col(key).alias("_base"), F.lit(1).alias("_n"))
    counted = existing.where(F.col(key).rlike("-[0-9]{1,9}$")).select(F.regexp_replace(key, "-[0-9]+$", "").alias("_base"), F.regexp_extract(key, "-([0-9]+)$", 1).cast("int").alias("_n"))
    taken = whole.union(counted).groupBy("_base").agg(F.max("_n").alias("_taken"))
    # Rows are numbered within range partitions, so a name that very many rows have is no hot task; stored, as they are read twice.
    ranged = based.repartitionByRange("_base", order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part", "_base").orderBy(order))), "named")
    parts = ranged.groupBy("_base", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    starts = parts.select("_base", "_part", (F.sum("_rows").over(Window.partitionBy("_base").orderBy("_part")) - F.col("_rows")).alias("_start"))
    placed = ranged.join(starts, ["_base", "_part"]).join(taken, "_base", "left").withColumn("_place", F.col("_n") + F.col("_start") + F.coalesce("_taken", F.lit(0)))
    return placed.withColumn(key, F.when(F.col("_place") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_place").cast("string")))).drop("_base", "_taken", "_place", "_part", "_n", "_start")


def cache_lookup(requests: DataFrame, captures: DataFrame, keys: list[str], ttl_seconds: float, at: str = "ts", created: str = "created_at", value: str = "id") -> DataFrame:
    """For each request the latest capture of the same keys that is not older than the time to live and not from the future: value and its age in seconds, null where none is. Of captures of one time the least value counts.

    Requests and captures are put in one order of time by key, and each request looks back at the last capture before it: a pass that
    grows with the rows, where a join by interval would grow with their pairs.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    row = F.struct(*requests.columns)
    row_type, value_type = requests.select(row.alias("r")).schema["r"].dataType, captures.schema[value].dataType
    asked = requests.select(*(F.col(k).alias(f"_{k}") for k in keys), micros(at).alias("_t"), F.lit(1).alias("_kind"), none("_value", value_type), row.alias("_row"))
    made = captures.select(*(F.col(k).alias(f"_{k}") for k in keys), micros(created).alias("_t"), F.lit(0).alias("_kind"), F.col(value).alias("_value"), none("_row", row_type))
    order = Window.partitionBy(*(f"_{k}" for k in keys)).orderBy("_t", "_kind", F.col("_value").desc())
    last = F.last(F.when(F.col("_kind") == 0, F.struct("_t", "_value")), ignorenulls=True).over(order)
    found = asked.unionByName(made).withColumn("_last", last).where("_kind = 1").withColumn("_age", F.col("_t") - F.col("_last._t"))
    fresh = F.col("_age") <= int(ttl_seconds * 1_000_000)
    return found.select("_row.*", F.when(fresh, F.col("_last._value")).alias("hit"), F.when(fresh, F.col("_age") / 1e6).alias("age_seconds"))
