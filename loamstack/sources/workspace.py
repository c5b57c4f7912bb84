"""Scans of a workspace tree: wiki pages, raw sources, control pages, schema. Spark reads every file, so any store will do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.functions.identity import digest, source_ref
from loamstack.functions.markdown import frontmatter, page_id, page_title
from loamstack.model import MAX_SOURCE_BYTES, LimitExceeded, ReadLimits, require_scope, struct
from loamstack.sources import tree

_FILES = "path string, modificationTime timestamp, length long, content binary"


def _scan(spark: SparkSession, root: str, folder: str, pattern: str = "*") -> DataFrame:
    """path (relative to the root), modified, length, content of the files below a folder; no row where it is missing."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{folder}")
    if not base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(base):
        return spark.createDataFrame([], _FILES).withColumnRenamed("modificationTime", "modified")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(f"{root.rstrip('/')}/{folder}")
    relative = F.regexp_extract("path", rf"^.*?/({folder}/.*)$", 1)
    marker = root.rstrip("/").rsplit("/", 1)[-1]
    after = F.substring_index(F.concat(F.lit("/"), F.substring_index("path", f"/{marker}/", -1)), "//", -1)
    name = F.regexp_replace(after, "^/", "")
    return found.select(F.when(name.startswith(f"{folder}/"), name).otherwise(relative).alias("path"), F.col("modificationTime").alias("modified"), "length", "content")


def wiki_files(spark: SparkSession, root: str) -> DataFrame:
    return _scan(spark, root, "wiki", "*.md").withColumn("digest", digest(F.col("content")))


def wiki_pages(spark: SparkSession, root: str, scope: str) -> DataFrame:
    """The pages of a workspace; the index and the log are files but no pages."""
    files = wiki_files(spark, root).withColumn("body", F.decode("content", "UTF-8")).withColumn("page_id", page_id(F.col("path"))).where("page_id IS NOT NULL")
    meta = frontmatter(F.col("body"))
    return files.withColumn("meta", meta).select(
        F.lit(require_scope(scope)).alias("scope"),
        "page_id",
        "path",
        page_title(F.col("body")).alias("title"),
        "body",
        "digest",
        F.array_sort(F.array_distinct(F.coalesce("meta.source_refs", F.array().cast("array<string>")))).alias("source_refs"),
        F.lit(True).alias("untrusted"),
        F.col("modified").alias("updated_at"),
    )


def control_page(spark: SparkSession, root: str, name: str) -> DataFrame:
    """path, body of the index or the log."""
    if name not in ("index", "log"):
        raise ValueError("only index and log are control pages")
    return wiki_files(spark, root).where(F.col("path") == f"wiki/{name}.md").select("path", F.decode("content", "UTF-8").alias("body"))


def schema_document(spark: SparkSession, root: str) -> dict:
    """digest, version and content of the workspace's schema.md."""
    row = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/schema.md").select(digest(F.col("content")).alias("digest"), F.regexp_extract(F.decode("content", "UTF-8"), r"(?m)^\s*(?:schema_)?version:\s*\"?([^\"\s]+)", 1).alias("version"), "content").first()
    return {"digest": row["digest"], "version": row["version"] or "1", "content": bytes(row["content"])}


_MANIFEST = struct("ok boolean, scope string, adapter string, id string, version string, digest string, media_type string")


@F.pandas_udf(_MANIFEST)
def manifest(content: pd.Series) -> pd.DataFrame:
    """A source manifest; ``ok`` is false if it can't be read or lacks a key."""
    import yaml

    names = ["scope", "adapter", "id", "version", "digest", "media_type"]

    def one(raw):
        try:
            data = yaml.safe_load(bytes(raw or b"").decode())
            values = [str(data.get(k) or "").strip() for k in names]
        except (yaml.YAMLError, UnicodeDecodeError, AttributeError):
            return (False, *[None] * 6)
        return (all(values[:5]), *values)

    return pd.DataFrame([one(x) for x in content], columns=["ok", *names])


def raw_records(spark: SparkSession, root: str, scope: str, files: DataFrame | None = None) -> DataFrame:
    """path, ref, digest, valid, error_class of every source directory: manifests and sources meet in a full outer join.

    ``files``: the entries of a mounted tree (``tree.entries``), of which links and unreadable files are classes of their own.
    """
    files = _scan(spark, root, "raw").withColumn("status", F.lit(tree.READ)) if files is None else files
    files = files.withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    manifests = files.where(F.col("path").endswith("/manifest.yaml")).select("dir", F.col("status").alias("m_status"), manifest(F.col("content")).alias("m"))
    sources = files.where(F.col("path").endswith("/source")).select("dir", F.col("status").alias("s_status"), "length", digest(F.col("content")).alias("found"))
    joined = manifests.join(sources, "dir", "full_outer")
    error = (
        F.when((F.col("m_status") == tree.LINK) | (F.col("s_status") == tree.LINK), "symlink")
        .when(F.col("m_status").isNull(), "manifest_missing")
        .when(F.col("m_status") != tree.READ, "manifest_unreadable")
        .when(~F.col("m.ok"), "manifest_invalid")
        .when(F.col("s_status").isNull(), "source_missing")
        .when((F.col("s_status") == tree.LARGE) | (F.col("length") > MAX_SOURCE_BYTES), "source_too_large")
        .when(F.col("s_status") != tree.READ, "source_unreadable")
        .when(F.col("found") != F.lower("m.digest"), "source_digest_mismatch")
    )
    own = joined.where(F.col("m.scope").isNull() | (F.col("m.scope") == scope) | ~F.col("m.ok")).withColumn("error_class", error)
    # a linked, special or unreadable folder or file that is neither a manifest nor a source
    other = files.where(~F.col("status").isin(tree.READ, tree.LARGE) & ~F.col("path").endswith("/manifest.yaml") & ~F.col("path").endswith("/source"))
    none = F.lit(None).cast("string")
    lost = other.select("path", none.alias("ref"), none.alias("digest"), F.lit(False).alias("valid"), F.when(F.col("status") == tree.LINK, "symlink").otherwise("source_unreadable").alias("error_class"))
    found = own.select(F.col("dir").alias("path"), source_ref(F.col("m.adapter"), F.col("m.id"), F.col("m.version")).alias("ref"), F.col("m.digest").alias("digest"), F.col("error_class").isNull().alias("valid"), "error_class")
    return found.unionByName(lost)


def read_source(spark: SparkSession, root: str, location: str, found: str, limits: ReadLimits | None = None) -> bytes:
    """The bytes of an accepted source, checked against its digest and the bounds of the read."""
    limits = limits or ReadLimits()
    row = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{location}/source").first()
    content = bytes(row["content"])
    import hashlib

    if hashlib.sha256(content).hexdigest() != found.lower():
        raise ValueError("the source is not the accepted one")
    if len(content) > limits.bytes or len(content.decode("utf-8", "replace")) > limits.characters:
        raise LimitExceeded("the source is larger than the limits of the read")
    return content


def init(spark: SparkSession, root: str) -> list[str]:
    """Make a workspace's folders and starter files where they are missing; nothing is overwritten. Returns what was made."""
    starters = {"schema.md": "# Schema\n\nversion: 1\n", "wiki/index.md": "# Index\n", "wiki/log.md": "# Log\n"}
    hadoop, made = spark._jvm.org.apache.hadoop.fs, []
    fs = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in ("raw", "wiki"):
        if not fs.exists(hadoop.Path(f"{root}/{folder}")):
            fs.mkdirs(hadoop.Path(f"{root}/{folder}"))
            made.append(folder)
    for name, text in starters.items():
        path = hadoop.Path(f"{root}/{name}")
        if not fs.exists(path):
            out = fs.create(path, False)
            out.write(bytearray(text.encode()))
            out.close()
            made.append(name)
    return made


def missing(spark: SparkSession, root: str) -> list[str]:
    """What a valid workspace has and this one lacks."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x for x in ("raw", "wiki", "schema.md", "wiki/index.md", "wiki/log.md") if not fs.exists(hadoop.Path(f"{root}/{x}"))]
