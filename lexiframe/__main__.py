"""Command line: python -m lexiframe words|frames|vectors|scores --help."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from lexiframe.config import Settings
from lexiframe.operators.experiments import export_epochs, resume_epochs
from lexiframe.plans import flows
from lexiframe.sources.artefacts import exists
from lexiframe.sources.vectors import read_word_vectors


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lexiframe")
    parser.add_argument("step", choices=["words", "frames", "vectors", "scores"])
    parser.add_argument("--train", required=True, help="labelled tab-separated file or folder")
    parser.add_argument("--test", required=True)
    parser.add_argument("--output", required=True, help="folder for kept steps and results")
    parser.add_argument("--size", type=int, default=100, help="word vector size")
    parser.add_argument("--iterations", type=int, default=25)
    parser.add_argument("--epochs", type=int, default=1, help="epochs of batches to write")
    parser.add_argument("--single-line", action="store_true", help="no field holds a line end: split large files")
    parser.add_argument("--classes", type=int, default=2)
    parser.add_argument("--stages", type=int, default=300)
    return parser.parse_args()


def main() -> None:
    args = arguments()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    settings = Settings.from_environment()
    spark = SparkSession.builder.appName("lexiframe").getOrCreate()
    out = args.output.rstrip("/")
    given = {"train": args.train, "test": args.test}
    docs = flows.ingest(spark, given, out, settings, not args.single_line)
    lost = flows.rejects(spark, given, out, settings, not args.single_line).count()
    logging.info("%d rows do not parse, see %s/rejects", lost, out)
    if args.step == "scores":
        flows.score_exports(docs, f"{out}/vectors", f"{out}/reports", f"{out}/table",
                            args.classes, stages=args.stages)
        return
    vocab = flows.build_vocabulary(docs, settings, out)
    if args.step == "words":
        flows.train_words(docs, vocab, out, args.size, settings, args.iterations)
    elif args.step == "frames":
        framed = flows.frame_corpus(docs.filter("split = 'train'"), vocab, settings)
        batches = spark.createDataFrame([("batches",)], "model string")
        done = [("batches", e) for e in range(args.epochs) if exists(spark, f"{out}/batches/epoch={e}/_SUCCESS")]
        first = resume_epochs(batches, spark.createDataFrame(done, "model string, epoch int")).first()
        for epoch in range(first["next_epoch"], args.epochs):  # an epoch's order is fixed by its number
            flows.epoch_batches(framed, epoch, settings).write.mode("overwrite").parquet(
                f"{out}/batches/epoch={epoch}")
    else:
        words = read_word_vectors(spark, out, args.size, settings)
        last = (export_epochs(args.iterations, settings.eval_gap) or [args.iterations])[-1]
        name = flows.experiment_name(spark, settings, "skipgram", "uni", args.size, 1, last)
        flows.export_vectors(docs, vocab, words, name, f"{out}/vectors")


if __name__ == "__main__":
    main()
