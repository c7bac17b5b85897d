"""Jobs: ``python -m tessera.jobs ingest|reindex ROOT STORE`` takes the Word files of ROOT into the table at STORE and prints counters."""

from __future__ import annotations

import json
import sys

from tessera.operators.ingest import Versions, classify, counters
from tessera.session import session
from tessera.streaming.feeds import ingest_files, reindex


def ingest(spark, root: str, store: str) -> dict:
    """Takes new and changed files in; what is stored of files that are gone stays. Counters: new, changed, unchanged, deleted, total."""
    versions = Versions(spark, store)
    old = versions.read()
    before = None if old is None else old.select("doc_id", "hash")
    ingest_files(spark, root, versions, f"{store}/failed", f"{store}/state").start().awaitTermination()
    after = versions.read()
    if after is None:
        return {"n_new": 0, "n_changed": 0, "n_unchanged": 0, "n_deleted": 0, "n_total": 0}
    after = after.select("doc_id", "hash")
    return counters(classify(after, after.limit(0) if before is None else before)).first().asDict()


def main(arguments: list[str]) -> None:
    job, root, store = arguments
    spark = session("tessera-jobs")
    done = ingest(spark, root, store) if job == "ingest" else reindex(spark, root, Versions(spark, store)).first().asDict()
    print(json.dumps(done))


if __name__ == "__main__":
    main(sys.argv[1:])
