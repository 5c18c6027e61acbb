"""python -m tesserae.cli JOB ...: thin commands over tables in Parquet."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from . import constants as C
from .functions import times
from .operators import features, models
from .plans import jobs
from .session import session
from .sources import sinks, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserae")
    sub = p.add_subparsers(dest="job", required=True)
    b = sub.add_parser("build-data", help="training matrix from reports, features and labels")
    for n in ("reports", "features", "labels", "out"):
        b.add_argument(f"--{n}", required=True)
    b.add_argument("--bands", default="6,12,18,24,30,36,42,48", help="lead times")
    b.add_argument("--flags", default="flag")
    b.add_argument("--min-reports", type=int, default=1)
    b.add_argument("--neg-keep", type=float, default=0.025)
    b.add_argument("--resume", action="store_true")
    b.add_argument("--start", help="first valid hour, as YYYY-MM-DD[ HH:MM]")
    b.add_argument("--end", help="hour before which valid hours end")
    b.add_argument("--members", type=int, default=6, help="runs of which the shares in --member-fields are counted")
    b.add_argument("--member-fields", help="fields of all runs (run, fxx, iy, ix, refc, refd, uh03, uh25)")
    b.add_argument("--static", help="static fields of the grid (iy, ix, ...)")
    b.add_argument("--flush-days", type=int, default=7, help="days that are built and put into the matrix at once")
    b.add_argument("--min-free-gb", type=float, default=0.0, help="stop before a flush if less disk is free")
    b.add_argument("--temporal", default="", help="features of which the hours before and after are added")
    a = sub.add_parser("augment-data", help="add columns to a matrix, in place unless --out is given")
    for n in ("matrix", "columns"):
        a.add_argument(f"--{n}", required=True)
    a.add_argument("--out")
    r = sub.add_parser("augment-labels", help="recompute labels, in place unless --out is given")
    for n in ("matrix", "labels"):
        r.add_argument(f"--{n}", required=True)
    r.add_argument("--out")
    t = sub.add_parser("train", help="fit the bands, save them, and predict cells if any are given")
    for n in ("matrix", "features"):
        t.add_argument(f"--{n}", required=True)
    t.add_argument("--models", help="folder for the models, their manifest and their metrics")
    t.add_argument("--cells")
    t.add_argument("--out")
    t.add_argument("--flag", default="flag")
    t.add_argument("--hazard", default="tor")
    t.add_argument("--bags", type=int, default=1)
    t.add_argument("--pooled", action="store_true")
    t.add_argument("--dist", help="column of the intensity class (below 0: unknown): fits the model of its distribution too")
    t.add_argument("--pib", help="column of the peak-intensity class, likewise")
    t.add_argument("--learner", choices=sorted(models.LEARNERS), default="gbt")
    t.add_argument("--leaves", type=int, default=31, help="leaves of a tree that grows best leaf first")
    t.add_argument("--l2", type=float, default=1.0)
    t.add_argument("--trees", type=int, default=40)
    t.add_argument("--depth", type=int, default=5)
    t.add_argument("--calibrator", choices=("isotonic", "logistic"), default="isotonic")
    t.add_argument("--cap", type=int, help="training rows at most")
    t.add_argument("--val-cap", type=int, help="validation rows at most")
    t.add_argument("--fmax", type=int, default=36)
    q = sub.add_parser("predict", help="probabilities of cells by saved models")
    for n in ("models", "cells", "out"):
        q.add_argument(f"--{n}", required=True)
    q.add_argument("--fmax", type=int, default=36)
    q.add_argument("--no-cache", action="store_true", help="compute anew what --out holds already")
    w = sub.add_parser("products", help="hourly, day-maximum and combined products of predictions")
    for n in ("predictions", "out"):
        w.add_argument(f"--{n}", required=True)
    f = sub.add_parser("build-fire-data", help="training matrix of fires from runs, features and fires")
    for n in ("runs", "features", "fires", "out"):
        f.add_argument(f"--{n}", required=True)
    f.add_argument("--min-fires", type=int, default=1)
    f.add_argument("--neg-keep", type=float, default=0.02)
    f.add_argument("--fmax", type=int, default=24)
    c = sub.add_parser("cluster", help="a table dealt into buckets by its keys, to be read as table:NAME and joined without a shuffle")
    for n in ("input", "name", "out"):
        c.add_argument(f"--{n}", required=True)
    c.add_argument("--keys", default="valid,iy,ix")
    c.add_argument("--buckets", type=int, default=200)
    st = sub.add_parser("build-static", help="terrain fields of the grid from elevations (iy, ix, elev)")
    for n in ("elevation", "out"):
        st.add_argument(f"--{n}", required=True)
    return p


def build_data(args: argparse.Namespace, read) -> None:
    done = read(args.out).select("run", "fxx").distinct() if args.resume and sinks.exists(read.spark, args.out) else None
    samples = jobs.plan_samples(read(args.reports), [int(x) for x in args.bands.split(",")], args.min_reports, done)
    for bound, op in ((args.start, ">="), (args.end, "<")):
        if bound:
            samples = samples.where(F.expr(f"valid {op} TIMESTAMP_NTZ '{bound}'"))
    state, labels = read(args.features), read(args.labels)

    def make(some):
        rows = jobs.build_matrix(some, state, labels, args.flags.split(","), args.neg_keep)
        if args.temporal:
            rows = jobs.with_temporal(rows, state, args.temporal.split(","))
        if args.member_fields:
            rows = jobs.member_chances(rows, read(args.member_fields), C.EXCEEDANCE, args.members)
        if args.static:
            static = read(args.static)
            rows = jobs.with_static(rows, static, [c for c in static.columns if c not in jobs.CELL])
        return rows

    if left := jobs.flush(samples, make, args.out, args.flush_days, args.min_free_gb):
        raise SystemExit(f"{left} days are left: go on with --resume when there is room")


def train(args: argparse.Namespace, read) -> None:
    names = args.features.split(",")
    matrix = read(args.matrix)
    caps = {s: n for s, n in (("train", args.cap), ("validation", args.val_cap)) if n}
    if caps:
        rest = matrix.where(~F.col("split").isin(*caps))
        matrix = tables.capped_splits(matrix, ["key"], caps).unionByName(rest)
    grown = {"rounds": args.trees, "leaves": args.leaves, "l2": args.l2}
    params = grown if args.learner == "leafwise" else {"maxIter": args.trees, "maxDepth": args.depth}
    sizes = jobs.classes_of(args.hazard)
    asked = {k: (c, sizes[k]) for k, c in (("dist", args.dist), ("pib", args.pib)) if c and k in sizes}
    bands = jobs.train(matrix, names, args.flag, args.bags, args.pooled, learner=args.learner, calibrator=args.calibrator, conditional=asked, conditional_settings=grown, **params)
    if args.models:
        models.save_bands(bands, names, args.models, hazard=args.hazard, flag=args.flag, pooled=args.pooled)
        checked = matrix.withColumn("band", F.lit("pooled") if args.pooled else times.lead_band(F.col("fxx")))
        sinks.append_metrics(matrix.sparkSession, f"{args.models}/metrics", models.metrics(bands, checked, names, args.flag))
    if args.cells and args.out:
        jobs.store(jobs.predict(bands, read(args.cells).where(F.col("fxx") <= args.fmax), names, args.hazard), args.out)
    print(json.dumps({"bands": sorted(bands), "features": names}))


def predict(args: argparse.Namespace, read) -> None:
    bands, about = models.load_bands(args.models)
    cells = read(args.cells).where(F.col("fxx") <= args.fmax)
    lacking = [f for f in about["features"] if f not in cells.columns]
    if lacking:
        raise SystemExit(f"cells lack features of the models: {', '.join(lacking)}")
    make = lambda rows: jobs.predict(bands, rows, about["features"], about["hazard"])
    if not args.no_cache:
        have = jobs.stored(cells.sparkSession, args.out, make(cells))
        cells = jobs.lacking(jobs.with_run(cells), have, about["hazard"])
        if cells.isEmpty():
            return
    jobs.store(make(cells), args.out)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session("tesserae")
    read = lambda path: tables.dataset(spark, path)
    read.spark = spark
    keys = ["valid", "iy", "ix"]
    if args.job == "build-data":
        build_data(args, read)
    elif args.job == "augment-data":
        sinks.overwrite(sinks.augmented(read(args.matrix), read(args.columns), keys), args.out or args.matrix)
    elif args.job == "augment-labels":
        sinks.overwrite(sinks.relabelled(read(args.matrix), read(args.labels), keys), args.out or args.matrix)
    elif args.job == "cluster":
        sinks.clustered(read(args.input), args.name, args.out, args.keys.split(","), args.buckets)
    elif args.job == "train":
        train(args, read)
    elif args.job == "predict":
        predict(args, read)
    elif args.job == "products":
        jobs.render(read(args.predictions), args.out)
    elif args.job == "build-fire-data":
        rows = jobs.build_fire_matrix(read(args.runs), read(args.features), read(args.fires), args.neg_keep, list(range(1, args.fmax + 1)), args.min_fires)
        sinks.append_parts(rows.withColumn("valid_date", F.to_date("valid")), args.out)
    else:
        sinks.overwrite(features.terrain(read(args.elevation)), args.out)


if __name__ == "__main__":
    main()
