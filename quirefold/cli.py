"""Command line: cut the JSONL output of a text extraction into chunks.

Exit codes: 0 done, 1 the run failed, 2 bad arguments or settings.
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from collections.abc import Sequence

from quirefold.config import ChunkingConfig, SegmentationError
from quirefold.constants import OCR_POLICIES, STRATEGIES


def _at_least(least: int):
    def parse(value: str) -> int:
        try:
            number = int(value)
        except ValueError:
            raise argparse.ArgumentTypeError(f"{value!r} is not an integer") from None
        if number < least:
            raise argparse.ArgumentTypeError(f"must be at least {least}")
        return number

    return parse


def parser() -> argparse.ArgumentParser:
    default = ChunkingConfig.default
    p = argparse.ArgumentParser(prog="quirefold", description=__doc__.splitlines()[0])
    p.add_argument("input", nargs="?", default="-", help="JSONL file or folder; - for standard input")
    p.add_argument("-o", "--output", default="-", help="JSONL file to write; - for standard output")
    p.add_argument("--strategy", choices=STRATEGIES, default=default("strategy"))
    p.add_argument("--max-tokens", type=_at_least(1), default=default("max_tokens"))
    p.add_argument("--overlap", type=_at_least(0), default=default("overlap"))
    p.add_argument("--min-chunk-tokens", type=_at_least(0), default=default("min_chunk_tokens"))
    p.add_argument("--tokenizer-model", default=default("tokenizer_model"), help="path to a tokenizer.json, or word-counter")
    p.add_argument("--cross-page", action="store_true", default=default("cross_page"))
    p.add_argument("--on-ocr-needed", choices=OCR_POLICIES, default=default("on_ocr_needed"))
    p.add_argument("--strict", action="store_true", default=default("strict"))
    return p


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    ns = parser().parse_args(argv)
    try:
        cfg = ChunkingConfig(**{k: v for k, v in vars(ns).items() if k not in ("input", "output")})
    except ValueError as e:
        print(f"quirefold: {e}", file=sys.stderr)
        return 2
    from quirefold.plans.stream_job import process_file, summary
    from quirefold.session import local_session, publish_file

    spark = spark or local_session()
    with tempfile.TemporaryDirectory() as folder:
        source, target = ns.input, ns.output
        if source == "-":
            source = os.path.join(folder, "input.jsonl")
            with open(source, "w", encoding="utf-8", newline="") as f:
                f.writelines(sys.stdin)
            source = publish_file(spark, source, "input")
        if target == "-":
            target = os.path.join(folder, "output.jsonl")
        try:
            made = process_file(spark, source, target, cfg)
        except (SegmentationError, FileNotFoundError) as e:
            print(f"quirefold: {e}", file=sys.stderr)
            return 1
        if ns.output == "-":
            with open(target, encoding="utf-8") as f:
                sys.stdout.writelines(f)
        stats, skipped = summary(made)
    print(", ".join(f"{k} {v}" for k, v in stats.items()), file=sys.stderr)
    for s in skipped:
        print(f"skipped {s['doc_id']} page {s['page_index']}: {s['reason']}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
