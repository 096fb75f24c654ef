"""``python -m chunkloom INPUT``: chunk a file, or standard input as ``-``;
``python -m chunkloom --serve [HOST:]PORT`` answers requests."""

from __future__ import annotations

import argparse
import json
import sys

from .plans.server import serve
from .plans.service import BadRequest, chunk_request


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chunkloom", description="Chunk a Markdown or parsed document.")
    out.add_argument("input", nargs="?", help="a file, or - for standard input")
    out.add_argument("--serve", metavar="[HOST:]PORT", help="answer requests over HTTP instead")
    out.add_argument("--input-format", choices=("auto", "markdown", "json"), default="auto")
    out.add_argument("--format", choices=("summary", "json", "jsonl"), default="summary")
    out.add_argument("--max-tokens", type=int)
    out.add_argument("--overlap", type=int)
    out.add_argument("--model-dir")
    out.add_argument("-o", "--output")
    return out


def rendered(chunks: list[dict], form: str) -> str:
    if form == "jsonl":
        return "\n".join(json.dumps(c, ensure_ascii=False) for c in chunks)
    if form == "json":
        return json.dumps(chunks, ensure_ascii=False, indent=2)
    lines = []
    for c in chunks:
        heading, preview = c["metadata"].get("nearest_heading") or "", " ".join(c["content"].split())
        lines.append(f"[{c['sequence']:3d}] {c['dominant_type']:<13} {c['token_count']:5d} tok  {heading[:30]:<30} {preview[:70]}")
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    if args.serve:
        host, _, port = args.serve.rpartition(":")
        serve(host or "0.0.0.0", int(port), args.model_dir)
        return 0
    if not args.input:
        arguments().error("an input is needed")
    try:
        text = sys.stdin.read() if args.input == "-" else open(args.input, encoding="utf-8").read()  # noqa: SIM115
        parsed = args.input_format == "json" or (args.input_format == "auto" and args.input.endswith(".json"))
        body = {"document": json.loads(text)} if parsed else {"text": text}
        got = chunk_request(body | {"max_tokens": args.max_tokens, "overlap_tokens": args.overlap}, args.model_dir)
    except (BadRequest, OSError, ValueError) as e:
        print(f"chunkloom: {e}", file=sys.stderr)
        return 2
    out = rendered(got["chunks"], args.format) + "\n"
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(out)
    else:
        sys.stdout.write(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
