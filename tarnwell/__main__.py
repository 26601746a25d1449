"""Command line: index, embed, rematerialize, collect, search, status, span, info over a worktree."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from tarnwell.service import Index
from tarnwell.sources.config import DIMENSIONS, Config, resolve
from tarnwell.sources.http_embedding import HttpClient
from tarnwell.sources.runtime import build_info, capabilities, repository_root


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tarnwell")
    p.add_argument("--root", default=".")
    p.add_argument("--folder", help="where the index is kept; <root>/.tarnwell unless given")
    p.add_argument("--config", help="a JSON file")
    p.add_argument("--embedding-url", help="an HTTP provider of embeddings; its key is read from TARNWELL_EMBEDDING_KEY")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--dry-run", action="store_true")
    sub.add_parser("status")
    sub.add_parser("embed").add_argument("--retry-terminal", action="store_true")
    sub.add_parser("rematerialize")
    sub.add_parser("info")
    sub.add_parser("collect")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-k", type=int)
    s.add_argument("--max-inline-bytes", type=int, default=0)
    s.add_argument("--mode", choices=("fts", "hybrid"), default="fts")
    r = sub.add_parser("span")
    r.add_argument("path")
    r.add_argument("start", type=int)
    r.add_argument("end", type=int)
    a = p.parse_args(args)
    config = None
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            config = resolve(f.read())
    spark = SparkSession.builder.appName("tarnwell").config("spark.ui.enabled", "false").getOrCreate()
    client, key = None, os.environ.get("TARNWELL_EMBEDDING_KEY", "")
    if a.embedding_url and key:
        known = config or Config()
        client = HttpClient(a.embedding_url, key, known.embedding_model, max(DIMENSIONS), "query" if a.command == "search" else "document")
    index = Index(spark, a.root, a.folder or os.path.join(a.root, ".tarnwell"), config, client)
    if a.command == "index":
        out = index.reindex(a.dry_run).__dict__
    elif a.command == "status":
        out = index.status()
    elif a.command == "embed":
        out = index.embed_documents(a.retry_terminal)
    elif a.command == "rematerialize":
        out = {"generation": index.rematerialize()}
    elif a.command == "info":
        out = {"build": build_info(), "root": repository_root(a.root), "capabilities": capabilities(spark, a.root, client)}
    elif a.command == "collect":
        out = {"folders": index.store.collect()}
    elif a.command == "search":
        out = index.search(a.query, a.k, a.max_inline_bytes, a.mode)
    else:
        out = index.read_span(a.path, a.start, a.end)
    print(json.dumps(out, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
