"""Files as tables, and tables as files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.session import materialize

# Folders that are never read.
SKIPPED = "__pycache__ node_modules venv env build dist target vendor site-packages eggs htmlcov coverage tmp".split()


def normal_path(path: Column | str, root: str | None = None) -> Column:
    """A path in its plain form: forward slashes, none doubled or at the end, no ./ before it, and without the root folder."""
    p = F.regexp_replace(F.replace(T.col(path), F.lit("\\"), F.lit("/")), "/+", "/")
    p = F.regexp_replace(p, r"^(?:\./)+|/$", "")
    if root:
        base = root.replace("\\", "/").rstrip("/") + "/"
        p = F.when(F.startswith(p, F.lit(base)), F.substr(p, F.lit(len(base) + 1))).otherwise(p)
    return p


def files(spark: SparkSession, root: str, glob: str = "*", skipped: list[str] | None = None) -> DataFrame:
    """(path, modified, length, content BINARY, modality) of all files under a folder.

    Hidden files and folders and the skipped folders are left out, as are files of an unknown kind.  Selecting without
    ``content`` reads no file.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace("path", "^.*?" + base.replace(".", r"\.") + "/", "")
    parts = F.split(path, "/")
    names = SKIPPED if skipped is None else skipped
    out = f.select(path.alias("path"), F.col("modificationTime").alias("modified"), "length", "content", T.modality(path).alias("modality"))
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(names))
    return out.where(~hidden & (F.col("modality") != "unknown"))


def texts(file_table: DataFrame) -> DataFrame:
    """(path, modified, length, text, content_hash): decoded texts, what is no UTF-8 replaced by U+FFFD; the hash of media files is that of their bytes."""
    is_text = F.col("modality").isin("code", "text")
    text = F.when(is_text, F.make_valid_utf8(F.col("content").cast("string")))
    return file_table.select("path", "modified", "length", "modality", text.alias("text"), F.sha2("content", 256).alias("content_hash"))


def changed_files(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """The files whose time or size differs from what is stored (path, modified, length), or that are not stored.

    A stored row without a size counts as changed.  Only these need their content read.
    """
    s = stored.select(F.col("path").alias("_p"), F.col("modified").alias("_m"), F.col("length").alias("_l"))
    same = (F.col("path") == F.col("_p")) & (F.col("modified") == F.col("_m")) & (F.col("length") == F.col("_l"))
    return seen.join(s, same, "left_anti")


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write ``df`` as a new version under ``path`` and return its folder; readers of older versions are not disturbed."""
    version = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(version)
    return version


def write_states(states: DataFrame, path: str) -> None:
    """Session states (session_id, chunk_id, turn_number, state): the state as JSON text, partitioned by session bucket."""
    kind = dict(states.dtypes)["state"]
    body = F.col("state") if kind == "string" else F.to_json("state")
    out = states.select("session_id", "chunk_id", "turn_number", body.alias("state")).withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(64)))
    out.write.mode("append").partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_states(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The states written by ``write_states``; with a schema, parsed (unparsable text gives null)."""
    s = spark.read.parquet(path).drop("bucket")
    return s.withColumn("state", F.from_json("state", schema)) if schema else s


def embed_notes(chunks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors (chunk_id, v), new (memory_id, content), errors (chunk_id)) of texts (chunk_id, text, values) to be embedded.

    A known chunk gets the vector; an unknown one becomes a memory note with the text's beginning (``add_memory``).  Requests
    whose own figures are not 32 numbers are errors.
    """
    from quillgraph.functions import embedding

    made = requests.where(F.col("chunk_id").isNotNull()).dropDuplicates(["chunk_id"]).select("chunk_id", "text", embedding.embedded("text", F.col("values")).alias("v"))
    good = made.where(F.col("v").isNotNull())
    new = good.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")
    notes = new.select(F.col("chunk_id").alias("memory_id"), F.substring("text", 1, embedding.EMBEDDED).alias("content"))
    return good.select("chunk_id", "v"), notes, made.where(F.col("v").isNull()).select("chunk_id")


def add_memory(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """``chunks`` with agents' notes (memory_id, content) as chunks of the path memory:<id>; an id that is there stays as it is.

    Both sides are written first, so the result does not read what a caller may overwrite.
    """
    path = F.concat(F.lit("memory:"), F.col("memory_id"))
    new = notes.where(F.col("memory_id").isNotNull() & F.col("content").isNotNull()).dropDuplicates(["memory_id"]).select(
        F.substring(F.sha2(path, 256), 1, 32).alias("chunk_id"), path.alias("document_path"), "content", F.floor(F.char_length("content") / 4).cast("long").alias("token_count")
    )
    kept = chunks.select("chunk_id", "document_path", "content", "token_count")
    return materialize(kept.unionByName(new.join(kept.select("chunk_id"), "chunk_id", "left_anti")), "memory")
