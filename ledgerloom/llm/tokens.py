"""Encoding a corpus with a public byte-level BPE vocabulary through a table of distinct words.

Texts are split into words by the vocabulary's own pattern in the JVM. Each distinct word is encoded
once (in Arrow batches, by the library that owns the vocabulary); ids return to the texts by a join on
the word and take their word's position. Frequent words are few and hold most occurrences: their ids
come from a broadcast of bounded size and are looked up where the text is, a column of words at a time.
Only the rare words of a text, each once with its number in the text, travel to the table and back, and
the text's ids meet them there; a text without rare words never leaves its task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import save

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
# The vocabulary's pattern in Java's terms, where \s alone would be ASCII white space.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
# Bound of the broadcast: so many words of at most so many characters, 4 MB at most in practice.
HOT_WORDS, HOT_LENGTH = 40_000, 24

_loaded: dict[str, object] = {}


def encoder(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _loaded[path] = made
    return _loaded[path]


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word) for every word of every text."""
    split = F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0))
    return docs.filter(F.col(text) != "").select(F.col(key).alias("_key"), F.posexplode(split).alias("_pos", "_word"))


def word_table(words: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(_word, n, ids): each distinct word of ``occurrences``, how often it occurs, and its ids."""
    path = vocabulary or f"{TOKENIZERS}/{VOCABULARY}"
    words.sparkSession.sparkContext.addFile(path)  # executors get the file from the driver
    name = os.path.basename(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(SparkFiles.get(name))
        for batch in batches:
            ids = [e.ids for e in tool.encode_batch_fast(batch.column("_word").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("_word"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["_word", "n", "ids"])

    counted = words.groupBy("_word").agg(F.count("*").alias("n"))
    return save(counted.mapInArrow(encode, "_word string, n long, ids array<int>"))


def _hot(table: DataFrame) -> DataFrame:
    """The most frequent short words: at most HOT_WORDS rows, whatever the corpus."""
    return table.filter(F.length("_word") <= HOT_LENGTH).orderBy(F.desc("n"), "_word").limit(HOT_WORDS)


def _known_ids(docs: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """(_key, ids, rare): the ids of every text with -1 - i for its i-th rare word, and its distinct rare words."""
    top = _hot(table).select("_word", "ids").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((top.column("_word").combine_chunks(), top.column("ids").combine_chunks()))
    kind = dict(docs.dtypes)[key]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = shared.value
        for batch in batches:
            lists = batch.column("_words")
            flat = lists.flatten()
            at = pc.index_in(flat, words)
            cut = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            missing = np.nonzero(at.is_null().to_numpy(zero_copy_only=False))[0]
            # A rare word's id is its number among the text's rare words.
            rare: list[list[str]] = [[] for _ in range(len(batch))]
            own = np.searchsorted(cut, missing, side="right") - 1
            number, seen, last = np.zeros(len(missing), dtype=np.int64), {}, -1
            for m, (row, word) in enumerate(zip(own.tolist(), flat.take(pa.array(missing)).to_pylist())):
                if row != last:
                    seen, last = {}, row
                if word not in seen:
                    seen[word] = len(rare[row])
                    rare[row].append(word)
                number[m] = seen[word]
            found = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.asarray(ids.offsets)
            size = (starts[found + 1] - starts[found]) if len(ids) else np.zeros(len(found), dtype=np.int64)
            size[missing] = 1
            ends = np.cumsum(size)
            take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
            values = np.asarray(ids.values) if len(ids) else np.zeros(1, dtype=np.int32)
            out = values[np.minimum(np.repeat(starts[found] if len(ids) else found, size) + take, len(values) - 1)].astype(np.int32)
            out[ends[missing] - 1] = -1 - number
            offsets = np.concatenate([[0], ends])[cut].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out)), pa.array(rare, pa.list_(pa.string()))], names=["_key", "ids", "rare"])

    split = F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0))
    return docs.select(F.col(key).alias("_key"), F.coalesce(split, F.array().cast("array<string>")).alias("_words")).mapInArrow(look_up, f"_key {kind}, ids array<int>, rare array<string>")


def _rare_ids(known: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """(_k, r): for each text its rare words' value of the table, in order of their numbers."""
    asked = known.filter(F.size("rare") > 0).select(F.col("_key").alias("_k"), F.posexplode("rare").alias("_i", "_word"))
    met = asked.join(table.select("_word", F.col(value).alias("_v")), "_word")
    return met.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("r"))


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, ids): one row per row of ``docs`` (``key`` must be unique), special strings being ordinary text.

    Null and empty texts have an empty list, defined as ``[]``. Texts are encoded whole, at any length.
    """
    table = word_table(occurrences(docs, key, text), vocabulary)
    known = save(_known_ids(docs, key, text, table))
    kind = dict(docs.dtypes)[key]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, rare in zip(batch.column("ids"), batch.column("r").to_pylist()):
                x = np.asarray(ids.values)
                holes = np.nonzero(x < 0)[0]
                parts, at = [], 0
                for h in holes.tolist():
                    parts += [x[at:h], np.array(rare[-1 - x[h]], dtype=np.int32)]
                    at = h + 1
                out.append(np.concatenate([*parts, x[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(out, pa.list_(pa.int32()))], names=[key, "ids"])

    rare = _rare_ids(known, table, "ids")
    mixed = known.filter(F.size("rare") > 0).join(rare, F.col("_key").eqNullSafe(F.col("_k"))).select("_key", "ids", "r").mapInArrow(fill, f"`{key}` {kind}, ids array<int>")
    return mixed.unionByName(known.filter(F.size("rare") == 0).select(F.col("_key").alias(key), "ids"))


def token_counts(docs: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, tokens) for every row of ``docs`` (``key`` must be unique); 0 for null and empty texts."""
    table = word_table(occurrences(docs, key, text), vocabulary)
    known = _known_ids(docs, key, text, table.withColumn("ids", F.array(F.size("ids"))))
    rest = save(known.select("_key", "rare", F.aggregate(F.filter("ids", lambda x: x >= 0), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.transform(F.filter("ids", lambda x: x < 0), lambda x: -1 - x).alias("holes")))
    rare = _rare_ids(rest, table.withColumn("tokens", F.size("ids").cast("long")), "tokens")
    held = F.aggregate("holes", F.lit(0).cast("long"), lambda a, i: a + F.get("r", i))
    mixed = rest.filter(F.size("rare") > 0).join(rare, F.col("_key").eqNullSafe(F.col("_k"))).select(F.col("_key").alias(key), (F.col("n") + held).alias("tokens"))
    return mixed.unionByName(rest.filter(F.size("rare") == 0).select(F.col("_key").alias(key), F.col("n").alias("tokens")))


def pieces(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """(id, piece): the bytes of every id, from the vocabulary's ranks; its size is fixed (50,256 rows)."""
    path = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    with open(path, "rb") as lines:
        rows = [(int(rank), bytearray(base64.b64decode(piece))) for piece, rank in map(bytes.split, lines)]
    return spark.createDataFrame(pa.table({"id": pa.array([r[0] for r in rows], pa.int32()), "piece": pa.array([bytes(r[1]) for r in rows], pa.binary())}))


def decode_corpus(encoded: DataFrame, key: str, vocabulary: str | None = None) -> DataFrame:
    """(key, text): ids turned back into text by a join with the table of pieces. An empty list gives ''."""
    flat = encoded.select(F.col(key).alias("_key"), F.posexplode_outer("ids").alias("_pos", "id"))
    named = flat.join(F.broadcast(pieces(encoded.sparkSession, vocabulary)), "id", "left")
    lists = named.groupBy("_key").agg(F.collect_list(F.struct("_pos", F.hex("piece").alias("_h"))).alias("_l"))
    text = F.decode(F.unhex(F.array_join(F.transform(F.array_sort("_l"), lambda x: x["_h"]), "")), "UTF-8")
    return lists.select(F.col("_key").alias(key), F.coalesce(text, F.lit("")).alias("text"))
