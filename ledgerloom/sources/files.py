"""Files as documents and pages, embeddings as rows, texts as vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.store import content_id

# Gets the bytes of a file, returns the texts of its pages in order.
Parser = Callable[[bytes], "list[str | None]"]


def plain_text(content: bytes) -> list[str]:
    """Pages of a text file: form feeds part them."""
    return content.decode("utf-8", errors="replace").split("\f")


def read_files(spark: SparkSession, path: str, parser: Parser = plain_text, pattern: str | None = None) -> DataFrame:
    """doc_id, filename, path, page_no, raw, error: the pages of every file under ``path``.

    doc_id is made from the bytes, so the same file under two names is one document. A file the parser fails on is one row
    with an error and no page; a file without pages likewise, without error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, where, content in zip(pdf["doc_id"], pdf["path"], pdf["content"]):
                try:
                    found, error = list(parser(bytes(content))), None
                except Exception as e:  # whatever the caller's parser raises
                    found, error = [], f"{type(e).__name__}: {e}"
                rows += [(doc, where, n, raw, None) for n, raw in enumerate(found, 1)] or [(doc, where, None, None, error)]
            yield pd.DataFrame(rows, columns=["doc_id", "path", "page_no", "raw", "error"]).astype({"page_no": "Int32"})

    keyed = files.select(content_id(F.col("content")).alias("doc_id"), "path", "content")
    pages = keyed.mapInPandas(parse, "doc_id string, path string, page_no int, raw string, error string")
    return pages.select("doc_id", F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "page_no", "raw", "error")


def embeddings(claims: DataFrame, dims: int | None = None) -> DataFrame:
    """claim_id, embedding of the claims that have a usable one: not empty, no null in it, not all zeros, of ``dims`` numbers if given."""
    rows = claims.select("claim_id", "embedding").filter("claim_id is not null and size(embedding) > 0")
    usable = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return rows.filter(usable & (F.size("embedding") == dims if dims else F.lit(True)))


def embedded_text(subject: Column, predicate: Column) -> Column:
    """What of a claim is embedded: its subject and property alone."""
    return F.concat(F.btrim(F.coalesce(subject, F.lit(""))), F.lit(" | "), F.btrim(F.coalesce(predicate, F.lit(""))))


def hashed_vector(text: Column, dims: int = 384) -> Column:
    """A stand-in for a sentence encoder: signed counts of hashed words and letter triples, of length one; null for null, zeros for a text without letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    triples = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3)))))
    parts = F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), F.transform(triples, lambda t: F.concat(F.lit("t:"), t)))
    hashed = F.transform(parts, lambda p: F.struct(F.pmod(F.xxhash64(p), F.lit(dims)).cast("int").alias("i"), F.when(F.pmod(F.hash(p), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(hashed, lambda h: h["i"] == d), F.lit(0.0), lambda a, h: a + h["s"]))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(text.isNotNull(), F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)).cast("float")))
