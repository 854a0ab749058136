"""python -m mathloom INDEX [-t TERM] [-m TEX] [-x TEXT] [-p PAGE] [-d DICT]: search an index; with
--build FOLDER first index the JSON corpus of a folder, with --serve run the HTTP daemon."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from mathloom.functions.segment import Segmenter
from mathloom.operators import rank
from mathloom.plans.engine import Engine, Index
from mathloom.plans.query import MESSAGES, Keyword, checked, term_keywords
from mathloom.plans.server import PORT, server
from mathloom.sources.corpus import json_corpus


class Word(argparse.Action):
    """Keeps keywords of all kinds in the order of the command line."""

    def __call__(self, parser: argparse.ArgumentParser, space: argparse.Namespace, value: object, option: str | None = None) -> None:
        words = getattr(space, "words", None) or []
        kind = {"-t": "term", "-m": "tex", "-x": "text"}[option or ""]
        space.words = [*words, Keyword(kind, str(value).lower() if kind == "term" else str(value))]


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="mathloom", description=__doc__)
    p.add_argument("index")
    for flag in ("-t", "-m", "-x"):
        p.add_argument(flag, action=Word, dest="words")
    p.add_argument("-p", "--page", type=int, default=1)
    p.add_argument("--lexer", default="eng", choices=("eng", "mix"))
    p.add_argument("-d", "--dictionary", help="file of words, to segment text without blanks")
    p.add_argument("--build")
    p.add_argument("--serve", action="store_true")
    p.add_argument("--port", type=int, default=PORT)
    own = p.parse_args(args)
    lexer = Segmenter.of_file(own.dictionary) if own.dictionary else own.lexer
    own.words = [k for w in own.words or [] for k in (term_keywords(w.text, lexer) if w.kind == "text" else [w])]
    spark = SparkSession.builder.appName("mathloom").getOrCreate()
    if own.build:
        Index.append(own.index, json_corpus(spark, own.build), lexer)
    engine = Engine(Index.open(spark, own.index, lexer))
    if own.serve:
        server(engine, port=own.port).serve_forever()
    if not own.words:
        return 0
    code = checked(own.words)
    hits = engine.search(own.words).collect() if not code else []
    if code or not hits:
        print(MESSAGES[code or 3])
        return code or 3
    _, _, pages = rank.page_window(len(hits), own.page)
    for hit in engine.page(hits, own.page, "\033[1m", "\033[0m"):
        print(f"{hit['docid']}  {hit['score']}  {hit['title']}\n  {hit['url']}\n  {hit['snippet']}\n")
    print(f"page {own.page} of {pages}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
