"""Commands: index, list, search, info. Each prints one JSON object per line; bad arguments end with 2, what is not there or failed with 1."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from cutloom.config import KINDS, Config
from cutloom.functions.text import payload_filter, prefixed, time_range
from cutloom.models import HashEncoder
from cutloom.operators import listing, search
from cutloom.operators.store import SnapshotStore
from cutloom.pipeline import Runner, default_stages
from cutloom.session import local_session
from cutloom.sources import table
from cutloom.sources.media import info


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cutloom")
    parser.add_argument("--data", required=True, help="folder of the tables; for index, of the store")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("index", help="run all stages of a video")
    a.add_argument("source", help="a file or an address")
    a.add_argument("--sources", required=True, metavar="MODULE:FUNCTION", help="what makes the pipeline.Sources of a session and a source")
    a.add_argument("--id", help="video id; the sources name one by default")
    a.add_argument("--force", action="store_true")
    a.add_argument("--no-captions", action="store_true")
    a.add_argument("--no-overlap", action="store_true")
    a.add_argument("--keyframe-interval", type=float)
    a = commands.add_parser("list", help="all segments that meet filters")
    a.add_argument("--video", required=True)
    a.add_argument("--kind", choices=KINDS)
    a.add_argument("--filter", action="append", default=[])
    a.add_argument("--range")
    b = commands.add_parser("search", help="the k best segments")
    b.add_argument("query")
    b.add_argument("--video")
    b.add_argument("--kind", action="append", choices=KINDS)
    b.add_argument("-k", type=int, default=10)
    commands.add_parser("info").add_argument("video")
    return parser


def _index(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.keyframe_interval is not None and args.keyframe_interval <= 0:
        raise ValueError(f"--keyframe-interval must be above 0, not {args.keyframe_interval}")
    module, _, name = args.sources.partition(":")
    sources = getattr(importlib.import_module(module), name)(spark, args.source)
    video = args.id or sources.video_id
    changes = {"keyframe_interval_s": args.keyframe_interval} if args.keyframe_interval else {}
    config = Config.for_workdir(args.data, with_captions=not args.no_captions, overlap=not args.no_overlap, **changes)
    failed = Runner(SnapshotStore(spark, args.data), default_stages(sources), config).index(video, args.force)
    print(f"indexed {video}" + (f", but for {', '.join(failed)}" if failed else ""), file=sys.stderr)
    return 1 if failed else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, encoders: dict | None = None) -> int:
    """Run a command; encoders map a space to an Encoder (stand-ins by default)."""
    args, config = _arguments().parse_args(argv), Config()
    spark = spark or local_session()
    try:
        if args.command == "index":
            return _index(args, spark)
        if args.command == "info":
            found = info(table(spark, args.data, "videos"), args.video)
            print(found or f"no video {args.video}", file=sys.stdout if found else sys.stderr)
            return 0 if found else 1
        segments = table(spark, args.data, "segments")
        if args.command == "list":
            between = time_range(args.range) if args.range else None
            lines = listing.list_lines(listing.list_delivered(segments, args.video, args.kind, dict(payload_filter(x) for x in args.filter), between))
        else:
            encoders = encoders or {space: HashEncoder(model) for space, model in config.models.items()}
            wanted = {s: encoders[s].encode([prefixed(args.query, config.query_prefix) if s == "text" else args.query])[0].tolist() for s in search.active_spaces(args.kind)}
            hits = search.hits(segments, wanted, {s: e.name for s, e in encoders.items()}, k=args.k, kinds=args.kind, video_id=args.video)
            lines = listing.search_lines(search.refined(hits, segments, wanted.get("text"), lambda: encoders["text"]))
        for line in lines.toLocalIterator():
            print(line["line"])
        return 0
    except (ValueError, RuntimeError) as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
