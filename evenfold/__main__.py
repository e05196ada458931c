"""python -m evenfold: process texts, replay events, show the settings."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from evenfold.config import Paths, resolve
from evenfold.schema import EVENTS


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="evenfold")
    p.add_argument("--profile")
    p.add_argument("--lang")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("show-config")
    run = sub.add_parser("process", help="a table of readings (source, variant, text), or with --images a folder of images, to the store under a root")
    run.add_argument("readings")
    run.add_argument("root")
    run.add_argument("--images", action="store_true", help="read the images with the tesseract command; its readings are kept under the root")
    again = sub.add_parser("replay", help="the events under a root (JSON lines) to winners, from the latest snapshots of its store if there are any")
    again.add_argument("root")
    again.add_argument("--document")
    a = p.parse_args(args)
    config = resolve(a.profile, a.lang, a.config)
    if a.command == "show-config":
        print(config.summary())
        return 0
    from evenfold.session import local_session

    spark = local_session()
    paths = Paths(a.root)
    if a.command == "process":
        from evenfold.operators import image
        from evenfold.plans import pipeline

        if a.images:  # reading images is what takes time, so it is done once
            made = paths.readings()
            pipeline.read_documents(image.read_gray(spark, a.readings), str(config.lang.value)).write.mode("overwrite").parquet(made)
        pipeline.persist(pipeline.process(spark.read.parquet(made if a.images else a.readings), F.current_timestamp(), config.profile.value), paths.store)
        return 0
    from evenfold.operators import replay
    from evenfold.sources import store

    events = store.read_jsonl(spark, paths.events, EVENTS + ", document_id string")
    events = events.where(F.col("document_id") == a.document) if a.document else events
    stored = store.Store(spark, paths.store).read("snapshots") if store.exists(spark, f"{paths.store}/snapshots") else None
    replay.from_latest(events, stored, a.document, config.profile.value).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
