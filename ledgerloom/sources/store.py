"""Documents, claims and relations as parquet tables: upserts, cascading deletes and reads.

Parquet has no MERGE, so an upsert is a union in which the latest row of a key wins; it is decided by an
aggregate with map-side combine, not a window, so a key delivered many times stays cheap.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.keys import clean_key
from ledgerloom.sources.scratch import _filesystem

KEYS = {"documents": "doc_id", "claims": "claim_id", "relations": "relation_id"}
STAMPS = {"documents": "ingested_at", "claims": "created_at", "relations": "created_at"}


def latest(df: DataFrame, key: str, at: str, columns: list[str] | None = None) -> DataFrame:
    """The last delivered row of every key, keys cleaned; rows without a key are left out. Ties: any one of equal rows.

    ``columns`` are those wanted besides the key: only these and ``at`` are read, shuffled and sorted.
    """
    wanted = [c for c in df.columns if c != key and (columns is None or c in columns)]
    kinds = dict(df.dtypes)
    keyed = df.select(clean_key(key).alias(key), F.col(at).alias("_at"), *wanted).filter(F.col(key).isNotNull())
    plain = [c for c in wanted if "map<" not in kinds[c]]
    order = F.struct(F.col("_at").isNotNull(), "_at", *([F.xxhash64(*plain)] if plain else []))
    if not wanted:
        return keyed.select(key).distinct()
    rows = keyed.groupBy(key).agg(F.max_by(F.struct(*wanted), order).alias("_x")).select(key, "_x.*")
    return rows.select(*[c for c in df.columns if c == key or c in wanted])


def content_id(content: Column) -> Column:
    """Identifier of a file by its bytes, so that the same file is the same document."""
    return F.substring(F.sha2(content, 256), 1, 16)



def completed(documents: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Documents whose latest row says they are extracted."""
    return latest(documents, "doc_id", "ingested_at", None if columns is None else [*columns, "status"]).filter(F.lower(F.btrim("status")) == "extracted")


def without_documents(claims: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and relations that stay when the documents ``gone`` (doc_id) are deleted: their claims go, and with a claim its relations."""
    ids = gone.select(clean_key("doc_id").alias("_d")).filter("_d is not null").distinct()
    dead = claims.join(ids, clean_key(claims["doc_id"]) == F.col("_d"), "left_semi").select(clean_key("claim_id").alias("_c")).distinct()
    kept = claims.join(ids, clean_key(claims["doc_id"]) == F.col("_d"), "left_anti")
    left = relations.join(dead, clean_key(relations["claim_a_id"]) == F.col("_c"), "left_anti")
    return kept, left.join(dead, clean_key(left["claim_b_id"]) == F.col("_c"), "left_anti")


def as_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nested columns as JSON text, the form that row stores keep."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def from_json(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.from_json(c, s) for c, s in schemas.items()})


def loose_json(text: Column, schema: str) -> Column:
    """The first JSON object in a text, fenced or embedded in prose; null if there is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


MOST_DELTAS = 16


class Store:
    """Parquet tables under one folder. A table is a series of folders, a base and what was added since, and a pointer file
    that names the current ones. A write makes a folder and then switches the pointer by a rename that replaces it, so a
    reader or a crash at any moment finds a whole table, the old one or the new one. An upsert writes its own rows only;
    the latest row of a key is decided on reading, and after ``MOST_DELTAS`` upserts the folders are merged into one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folders(self, name: str) -> list[str]:
        path, fs = _filesystem(self.spark, f"{self.root}/{name}/CURRENT")
        if not fs.exists(path):
            return []
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame | None:
        folders = self._folders(name)
        parts = [self.spark.read.parquet(f"{self.root}/{name}/{f}") for f in folders]
        if not parts:
            return None
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more, allowMissingColumns=True)
        return latest(every, KEYS[name], STAMPS[name]) if len(parts) > 1 else every

    def _switch(self, name: str, folders: list[str]) -> None:
        """Points to ``folders`` and deletes those that neither they nor the list before them name."""
        before = self._folders(name)
        jvm = self.spark.sparkContext._jvm
        made, fs = _filesystem(self.spark, f"{self.root}/{name}/.CURRENT-{uuid.uuid4().hex}")
        out = fs.create(made, True)
        out.write(" ".join(folders).encode())
        out.close()
        current, _ = _filesystem(self.spark, f"{self.root}/{name}/CURRENT")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(made, current, overwrite)
        for old in fs.listStatus(current.getParent()):
            leaf = old.getPath().getName()
            if leaf.startswith("v-") and leaf not in folders and leaf not in before:
                fs.delete(old.getPath(), True)

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{folder}")
        return folder

    def _replace(self, name: str, df: DataFrame) -> None:
        self._switch(name, [self._write(name, df)])

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Adds rows; of a key already there the later row stays. New columns are added, missing ones are null."""
        have = self._folders(name)
        self._switch(name, [*have, self._write(name, latest(rows, KEYS[name], STAMPS[name]))])
        if len(have) >= MOST_DELTAS:
            self._replace(name, self.table(name))

    def remove(self, name: str, keys: DataFrame) -> None:
        """Deletes the rows with one of ``keys`` (one column, the table's key)."""
        have = self.table(name)
        if have is not None:
            self._replace(name, have.join(keys, KEYS[name], "left_anti"))

    def delete_document(self, doc_id: str) -> bool:
        """Deletes a document with its claims and their relations; False if it isn't there."""
        docs = self.table("documents")
        gone = None if docs is None else docs.filter(clean_key("doc_id") == doc_id.strip().lower()).select("doc_id")
        if gone is None or not gone.limit(1).count():
            return False
        ids = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        claims, relations = self.table("claims"), self.table("relations")
        if claims is not None:
            kept, left = without_documents(claims, relations if relations is not None else self.spark.createDataFrame([], "claim_a_id string, claim_b_id string"), ids)
            if relations is not None:
                self._replace("relations", left)
            self._replace("claims", kept)
        self._replace("documents", docs.filter(clean_key("doc_id") != doc_id.strip().lower()))
        return True


def export_sample(rows: DataFrame, kind: str, quota: int, order: list[Column]) -> DataFrame:
    """At most ``quota`` rows of each kind in the given order; a sample is what this is for."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).filter(F.col("_r") <= quota).drop("_r")


def export_claims(claims: DataFrame, quota: int) -> DataFrame:
    """A readable sample of claims: a quarter grounded prose, half table cells, the rest of the quota whatever is flagged,
    each the most telling first; a sample is what this is for."""
    flagged = F.coalesce("needs_review", F.lit(False)) | F.coalesce("quarantined", F.lit(False))
    group = F.when(flagged, "flagged").when(F.col("origin") == "table", "table").otherwise("prose")
    share = {"prose": quota // 4, "table": quota // 2, "flagged": quota - quota // 4 - quota // 2}
    most = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    order = [F.when(flagged, F.col("final_confidence")).asc_nulls_last(), F.desc_nulls_last("final_confidence"), F.col("claim_id")]
    ranked = claims.withColumn("_g", group).withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(*order)))
    return ranked.filter(F.col("_r") <= F.element_at(most, F.col("_g"))).drop("_g", "_r")
