"""Command line: attach sources, ask one question, a shell, or HTTP.

    python -m astrolith main.cpp -e "SELECT name FROM functions"
    python -m astrolith --project src -i
    python -m astrolith a.cpp:one b.cpp:two --http 8080
"""

from __future__ import annotations

import argparse
import os
import sys

from astrolith import __version__
from astrolith.plans.dialect import looks_like_sql
from astrolith.render import text_table
from astrolith.session import FactSession, SessionError
from astrolith.sources import compile_db, discovery, facts

_WITH_VALUE = ("-I", "-D", "-isystem", "-include", "-x")
HELP = ".tables  .schema <table>  .attached  .info  .help  .quit   statements end with ;"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="astrolith", allow_abbrev=False)
    p.add_argument("-e", "-q", dest="query")
    p.add_argument("-i", dest="interactive", action="store_true")
    p.add_argument("-s", "--source", action="append", default=[])
    p.add_argument("--facts", help="folder of <table>.parquet instead of sources")
    p.add_argument("--http", nargs="?", const=8080, type=int)
    p.add_argument("--bind", default="127.0.0.1")
    p.add_argument("--token", default="")
    p.add_argument("--compile-commands")
    p.add_argument("--build-dir")
    p.add_argument("--project")
    p.add_argument("--pattern", action="append")
    p.add_argument("--exclude", action="append")
    p.add_argument("--prefer-definition", action="store_true")
    p.add_argument("--cache", action="store_true")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--cache-dir")
    p.add_argument("--clear-cache", action="store_true")
    p.add_argument("--cache-verbose", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def split_arguments(argv: list[str]) -> tuple[argparse.Namespace, list[str], list[str]]:
    """(options, positional sources, compiler arguments)."""
    tail: list[str] = []
    if "--" in argv:
        i = argv.index("--")
        argv, tail = argv[:i], argv[i + 1 :]
    # a source right after --http is no port
    argv = [x for i, a in enumerate(argv) for x in ([a, "8080"] if a == "--http" and not (i + 1 < len(argv) and argv[i + 1].isdigit()) else [a])]
    options, rest = _parser().parse_known_args(argv)
    sources, clang, i = [], [], 0
    while i < len(rest):
        a = rest[i]
        if a.startswith("-"):
            clang.append(a)
            if a in _WITH_VALUE and i + 1 < len(rest):
                i += 1
                clang.append(rest[i])
        else:
            sources.append(a)
        i += 1
    return options, options.source + sources, clang + tail


def default_cache_dir() -> str:
    return os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "astrolith")


def attach_all(session: FactSession, o: argparse.Namespace, sources: list[str], clang: list[str]) -> None:
    """Attach what the command line names; raises SessionError."""
    session.set_default_args(clang)
    if o.cache or o.cache_dir:
        if not o.no_cache:
            session.enable_cache(o.cache_dir or default_cache_dir(), o.cache_verbose)
    if o.compile_commands or o.build_dir:
        if not session.load_compile_commands(o.compile_commands or o.build_dir):
            raise SessionError("cannot read the compile commands")
    if o.facts:
        session.attach_parquet(o.facts)
        return
    if o.project:
        config = discovery.ProjectConfig(o.project)
        config.patterns = o.pattern or config.patterns
        config.exclude = o.exclude or config.exclude
        session.attach_project(config, prefer_definition=o.prefer_definition)
        return
    specs: list[tuple[str, str | None]] = []
    for s in sources:
        path, schema = discovery.parse_file_spec(s)
        specs += [(p, None) for p in discovery.expand_glob(path)] if discovery.is_glob(path) else [(path, schema)]
    if session.compile_db and not specs:
        kept = [c.path for c in session.compile_db if discovery.matches_filters(c.path, o.pattern or [], o.exclude or [])]
        specs = [(p, None) for p in dict.fromkeys(kept)]
    if not specs:
        raise SessionError("no source files")
    for path, schema in specs:
        session.attach(path, schema, prefix=len(specs) > 1)


def shell(session: FactSession, lines, out=sys.stdout) -> int:
    """Dot commands and statements until .quit or the end of input."""
    pending = ""
    for line in lines:
        text = line.strip()
        if not pending and text.startswith("."):
            word, *rest = text.split()
            if word in (".quit", ".exit"):
                return 0
            if word == ".tables":
                print("\n".join(session.tables()), file=out)
            elif word == ".schema":
                for t in rest or session.tables():
                    try:
                        print(session.describe(t), file=out)
                    except Exception as e:
                        print(f"Error: {str(e).splitlines()[0]}", file=out)
            elif word == ".attached":
                print("\n".join(s or "main" for s in session.attached_schemas()), file=out)
            elif word == ".info":
                print(f"astrolith {__version__}, {len(session.tables())} tables", file=out)
            else:
                print(HELP, file=out)
            continue
        pending += line if line.endswith("\n") else line + "\n"
        if text.endswith(";"):
            statement, pending = pending, ""
            if not looks_like_sql(statement):
                print("Error: not a statement", file=out)
                continue
            columns, rows, error = session.exec(statement)
            print(f"Error: {error}" if error else text_table(columns, rows), end="\n" if error else "", file=out)
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    options, sources, clang = split_arguments(sys.argv[1:] if argv is None else argv)
    if options.clear_cache:
        print(f"{facts.FactCache(None, options.cache_dir or default_cache_dir()).clear()} entries cleared", file=sys.stderr)
        if not (sources or options.project or options.facts):
            return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("astrolith").getOrCreate()
    session = FactSession(spark)
    try:
        attach_all(session, options, sources, clang)
    except SessionError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    if options.query:
        columns, rows, error = session.exec(options.query)
        if error:
            print(f"Error: {error}", file=sys.stderr)
            return 1
        print(text_table(columns, rows), end="")
        return 0
    if options.http is not None:
        from astrolith.server import make_server

        if options.bind not in ("127.0.0.1", "localhost", "::1") and not options.token:
            print("warning: listening beyond this machine without a token", file=sys.stderr)
        make_server(session, options.bind, options.http, options.token).serve_forever()
        return 0
    if options.interactive:
        return shell(session, sys.stdin)
    return 0
