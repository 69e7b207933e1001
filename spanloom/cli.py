"""Commands ``aln`` and ``light``: alignments of a target in a source as JSON, or the source with them highlighted."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanloom.operators import align, render, tokens
from spanloom.sources.files import load_text

log = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom", description="align token spans that need not be contiguous")
    top.add_argument("--verbose", action="store_true", help="print debugging information")
    commands = top.add_subparsers(dest="command", metavar="<CMD>")
    for name, about in (("aln", "list alignments"), ("light", "highlight alignments")):
        p = commands.add_parser(name, help=about)
        p.add_argument("-s", "--source", required=True, help="source text, or a text file")
        p.add_argument("-o", "--output", help="write here instead of to standard output")
        p.add_argument("-tt", "--tokenization-type", choices=["token", "whitespace"], default="token")
        p.add_argument("--vocabulary", help="file of ranks for subwords")
        p.add_argument("target", help="target text, or a text file")
        if name == "aln":
            p.add_argument("--single", action="store_true", help="only the first alignment (null if there is none)")
        else:
            p.add_argument("--compat", action="store_true", help="marks in the raw text, alignments without separator in files")
    return top


def all_alignments(spark: SparkSession, source: str, target: str, ttype: str, vocabulary: str | None = None) -> list[list[dict]]:
    tokenizer = None
    if ttype == "token":
        import public_tokenizers

        tokenizer = tokens.subword_tokenizer(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    pair = spark.createDataFrame([(1, source, target)], "id int, source string, target string")
    src, tgt = (tokens.tokenize(pair, "id", c, ttype, tokenizer) for c in ("source", "target"))
    found = align.candidates(align.collapsed_steps(tgt, src, "id"), src, "id")
    rows = align.with_tokens(align.enumerate_chains(found, "id"), src, "id").orderBy("alignment_id", "step")
    out: list[list[dict]] = []
    for r in rows.toLocalIterator():
        if r["step"] == 0:
            out.append([])
        out[-1].append({k: r[k] for k in ("token", "enc_token", "start_idx", "end_idx")})
    return out


def highlighted(spark: SparkSession, source: str, alignments: list[list[dict]], compat: bool) -> list[str]:
    from spanloom.functions.text import norm_text

    kind = "array<struct<token:string,enc_token:string,start_idx:int,end_idx:int>>"
    rows = [(i, source, [(t["token"], str(t["enc_token"]), t["start_idx"], t["end_idx"]) for t in a]) for i, a in enumerate(alignments)]
    df = spark.createDataFrame(rows, f"i int, source string, tokens {kind}")
    text = F.col("source") if compat else norm_text("source")
    return [r[0] for r in df.orderBy("i").select(render.highlight(text, F.col("tokens"))).collect()]


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    top = parser()
    if len(argv) < 2:
        commands = next(a for a in top._actions if isinstance(a, argparse._SubParsersAction)).choices
        commands.get(argv[0] if argv else "", top).print_help(sys.stderr)
        return 1
    args = top.parse_args(argv)
    if args.command is None:
        top.print_help(sys.stderr)
        return 1
    logging.basicConfig(format="[%(asctime)s] %(levelname)7s %(message)s", level=logging.DEBUG if args.verbose else logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    source, target = load_text(args.source), load_text(args.target)
    found = all_alignments(spark, source, target, args.tokenization_type, args.vocabulary)
    log.info("%d alignments found", len(found))
    if args.command == "aln":
        text = json.dumps((found[0] if found else None) if args.single else found, indent=4)
    else:
        text = ("" if args.output and args.compat else "\n").join(highlighted(spark, source, found, args.compat))
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
