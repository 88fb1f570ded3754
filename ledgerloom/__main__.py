"""Command line: ``python -m ledgerloom ingest FILES STORE``, ``relate STORE``, ``stats STORE``, ``export STORE OUT [--quota N]``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from ledgerloom.operators import review, strategies
from ledgerloom.plans.engine import Engine
from ledgerloom.session import local_session
from ledgerloom.sources import files
from ledgerloom.sources.store import Store, export_claims, export_sample


def _engine(store: Store) -> Engine:
    empty = lambda schema: store.spark.createDataFrame([], schema)
    documents, claims, relations = (store.table(n) for n in ("documents", "claims", "relations"))
    return Engine(
        documents if documents is not None else empty("doc_id string, ingested_at double, status string"),
        claims if claims is not None else empty("claim_id string, created_at double"),
        relations if relations is not None else empty("relation_id string, claim_a_id string, claim_b_id string, kind string, decided_by string, confidence double, similarity double, created_at double"),
    )


def ingest(store: Store, path: str, pattern: str | None) -> None:
    pages = files.read_files(store.spark, path, pattern=pattern)
    now = F.unix_timestamp().cast("double")
    documents = pages.groupBy("doc_id").agg(F.min("filename").alias("filename"), F.min("path").alias("path"), F.count("page_no").cast("int").alias("pages_read"), F.max("error").alias("error"))
    store.upsert("documents", documents.withColumns({"ingested_at": now, "status": F.when(F.col("error").isNull(), "extracted").otherwise("failed")}))
    claims = _engine(store).ingest(pages.filter("raw is not null").select("doc_id", "page_no", "raw").dropDuplicates(["doc_id", "page_no"]))
    named = claims.withColumnsRenamed({"combined": "final_confidence", "is_quarantined": "quarantined", "is_review": "needs_review"}).withColumns({"created_at": now, "ctx_unit": F.col("unit")})
    store.upsert("claims", named)
    review.ingest_report(store.table("claims"), pages).show(truncate=False)


def relate(store: Store) -> None:
    claims = store.table("claims")
    missing = [c for c in ("ctx_geography", "ctx_as_of", "ctx_denominator") if c not in claims.columns]
    full = claims.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else claims
    found = Engine(store.table("documents"), full, store.spark.createDataFrame([], "relation_id string, created_at double")).relate()
    store.upsert("relations", found.withColumn("created_at", F.unix_timestamp().cast("double")))
    review.relate_report(store.table("relations")).orderBy("kind").show()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "relate", "stats", "export"):
        sub = commands.add_parser(name)
        if name == "ingest":
            sub.add_argument("files")
            sub.add_argument("--pattern")
            sub.add_argument("--extractor", default="deterministic")
        sub.add_argument("store")
        if name == "export":
            sub.add_argument("out")
            sub.add_argument("--quota", type=int, default=40)
    asked = parser.parse_args(args)
    store = Store(local_session(), asked.store)
    if asked.command == "ingest":
        strategies.strategy(asked.extractor, strict=True)  # the command line has no model to offer
        ingest(store, asked.files, asked.pattern)
    elif asked.command == "relate":
        relate(store)
    elif asked.command == "stats":
        _engine(store).stats().show() if store.table("claims") is not None else print("empty store")
    else:
        export_claims(store.table("claims"), asked.quota).write.mode("overwrite").json(f"{asked.out}/claims")
        if (relations := store.table("relations")) is not None:
            export_sample(relations, "kind", asked.quota, [F.desc_nulls_last("confidence"), F.col("relation_id")]).write.mode("overwrite").json(f"{asked.out}/relations")


if __name__ == "__main__":
    main()
