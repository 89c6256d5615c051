"""python -m verdigris score | materialize | compare | robustness"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import verbs
from .functions.paths import relative_to
from .functions.pixels import PPM, Codec
from .operators.sampling import balanced
from .sources import readers


def _named(spec: str):
    """What `module:attribute` names."""
    module, _, attribute = spec.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="verdigris")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--root", help="a tree of images labelled by their folders")
    common.add_argument("--splits", help="a JSON file of named splits and their trees; --split then says which of them is read")
    common.add_argument("--max-images", type=int, help="a balanced seeded sample of so many")
    common.add_argument("--seed", type=int, default=42)
    common.add_argument("--threshold", type=float, default=0.5)
    common.add_argument("--split", default="")
    common.add_argument("--out", help="where results go")
    images = argparse.ArgumentParser(add_help=False)
    images.add_argument("--conditions", default="daily")
    images.add_argument("--stem", help="the name of the tables, instead of the verb's")
    images.add_argument("--work-dir", help="where images under conditions are, instead of OUT/work")
    images.add_argument("--codec", help="module:(decode, encode, lossy); without one, binary PPM files are read and JPEG is refused")
    images.add_argument("--limit", type=int, default=0, help="materialize: the first so many items only")
    images.add_argument("--crop-resize-back", action="store_true", help="materialize: cropped images keep their size")
    images.add_argument("--overwrite", action="store_true", help="materialize: make images that are there again")
    verb = parser.add_subparsers(dest="verb", required=True)
    one = verb.add_parser("score", parents=[common])
    one.add_argument("--pred", required=True)
    one.add_argument("--predict-root")
    one.add_argument("--condition", default="clean")
    verb.add_parser("materialize", parents=[common, images])
    for name in ("compare", "robustness"):
        verb.add_parser(name, parents=[common, images]).add_argument("--model", action="append", required=True, help="name=module:predictor")
    args = parser.parse_args(given)
    if args.splits and not args.root:
        with open(args.splits, encoding="utf-8") as f:
            args.root = readers.split_root(json.load(f), args.split)
    if not args.root:
        parser.error("--root, or --splits and --split, are needed")
    if args.verb != "score" and not args.out:
        parser.error("--out is needed")
    if args.verb == "robustness" and len(args.model) != 1:
        parser.error("robustness takes one model")
    if args.verb in ("compare", "robustness") and any("=" not in m for m in args.model):
        parser.error("--model needs name=module:predictor")
    return args


def main(given: list[str] | None = None) -> None:
    args = _arguments(given)
    spark = SparkSession.builder.appName("verdigris").getOrCreate()
    labelled = readers.labelled_tree(spark, args.root)
    if args.max_images is not None:
        labelled = balanced(labelled, args.max_images, args.seed, "path")
    if args.verb == "score":
        found, errors = verbs.score(
            spark, args.pred, labelled, args.root, args.predict_root, args.threshold, split=args.split, condition=args.condition
        )
        told = {"metrics": found.first().asDict(), "errors": [r.asDict() for r in errors.orderBy("error_type", "place").collect()]}
        print(json.dumps(told["metrics"], indent=2))
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                json.dump(told, f, indent=2)
        return
    codec = Codec(*_named(args.codec)) if args.codec else PPM
    content = readers.images(spark, args.root, content=True).select("path", "content")
    items = labelled.select("path", F.col("y").alias("label")).join(content, "path")
    items = items.select(relative_to(F.col("path"), args.root).alias("image_id"), "content", "label")
    if args.verb == "materialize":
        options = {"limit": args.limit, "resize_back": args.crop_resize_back, "overwrite": args.overwrite, "split": args.split}
        told = verbs.materialize(items, args.conditions, args.out, codec, **options)
        print(f"rows={told['rows']} made={told['made']} skipped={told['skipped']} below {args.out}")
        return
    models = {name: _named(spec) for name, _, spec in (m.partition("=") for m in args.model)}
    table, errors = verbs.compare(items, models, args.conditions, args.work_dir or f"{args.out}/work", codec, args.threshold, args.split)
    paths = verbs.write_tables(table, args.out, args.stem or args.verb, args.conditions if args.verb == "compare" else "", list(models))
    errors.write.mode("overwrite").json(f"{args.out}/errors")
    print("\n".join(f"wrote {p}" for p in [*paths, f"{args.out}/errors"]))


if __name__ == "__main__":
    main()
