"""A thin command line over the store: python -m siltstone.cli STORE COMMAND ...

STORE is an address or a remote's name; ``.`` is the store around this folder. What add, rm and mv stage is
kept for the user until it is committed or reset.
"""

from __future__ import annotations

import argparse
import getpass
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siltstone.operators import catalog, verify
from siltstone.operators.store import Repository, StoreError
from siltstone.plans import predicate
from siltstone.session import session
from siltstone.sources import files, registry
from siltstone.sources.remotes import Remotes, discover

#: Every command's arguments, as add_argument takes them.
COMMANDS: dict[str, list[tuple[tuple[str, ...], dict]]] = {
    "init": [],
    "remote": [(("action",), {"choices": ("add", "remove", "list")}), (("name",), {"nargs": "?"}), (("target",), {"nargs": "?"})],
    "add": [(("source",), {}), (("--reader",), {}), (("--existing",), {"choices": ("error", "skip", "replace"), "default": "error"}), (("-m", "--message"), {})],
    "rm": [(("path",), {})],
    "mv": [(("old",), {}), (("new",), {})],
    "status": [],
    "reset": [(("subjects",), {"nargs": "*"})],
    "commit": [(("-m", "--message"), {"required": True})],
    "log": [(("-n",), {"type": int})],
    "show": [(("version",), {"nargs": "?"})],
    "ls": [(("path",), {"nargs": "?", "default": ""})],
    "find": [(("--datatype",), {}), (("--sub",), {}), (("--version",), {}), (("entities",), {"nargs": "*", "metavar": "NAME=VALUE"})],
    "query": [
        (("expression",), {"nargs": "?"}),
        (("--where",), {"action": "append", "default": []}),
        (("--version",), {}),
        (("--columns",), {}),
        (("--json",), {"action": "store_true"}),
        (("--csv",), {"action": "store_true"}),
        (("--count",), {"action": "store_true"}),
    ],
    "diff": [(("a",), {"nargs": "?"}), (("b",), {"nargs": "?"}), (("--exit-code",), {"action": "store_true"})],
    "branch": [(("name",), {"nargs": "?"}), (("version",), {"nargs": "?"})],
    "tag": [(("name",), {}), (("version",), {"nargs": "?"})],
    "switch": [(("name",), {})],
    "merge": [(("other",), {}), (("--prefer",), {"choices": ("mine", "other")})],
    "revert": [(("version",), {})],
    "clone": [(("target",), {}), (("--version",), {})],
    "gc": [(("older_than",), {"type": float}), (("--delete",), {"action": "store_true"})],
    "validate": [(("source",), {}), (("--reader",), {})],
    "verify": [(("source",), {}), (("--reader",), {})],
    "export": [(("target",), {}), (("--version",), {})],
    "migrate": [(("source",), {}), (("--dry-run",), {"action": "store_true"})],
    "fsck": [],
}

#: Commands that look at, or change, what is staged.
STAGING = ("add", "rm", "mv", "status", "reset", "commit", "switch", "diff")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siltstone")
    out.add_argument("store")
    out.add_argument("--branch")
    out.add_argument("--user", default=None)
    commands = out.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        one = commands.add_parser(name)
        for names, options in arguments:
            one.add_argument(*names, **options)
    return out


def _lines(rows) -> None:
    for row in rows:
        print(row)


def _issues(found) -> int:
    """Print issues; 1 if one of them is an error."""
    rows = found.orderBy("severity", "code", "location")
    worst = 0
    for row in catalog.streamed(rows):
        print(f"{row['severity']}: {row['code']}: {row['location']}: {row['message']}")
        worst |= row["severity"] == "error"
    return int(worst)


def _query(repo: Repository, args: argparse.Namespace) -> None:
    if sum((args.json, args.csv, args.count)) > 1:
        raise ValueError("one of --json, --csv and --count")
    filters = dict(w.split("=", 1) for w in args.where)
    found = predicate.where(repo.read(args.version), args.expression, **filters).orderBy("sub", "path")
    found = found.select(*[F.col(f"`{c}`") for c in args.columns.split(",")]) if args.columns else found
    if args.count:
        print(found.count())
    elif args.json or args.csv:
        made = catalog.output(found, [f"`{c}`" for c in found.columns], "json" if args.json else "csv")
        _lines(row[0] for row in catalog.streamed(made))
    else:
        _lines(row["path"] for row in catalog.streamed(found.select("path")))


def run(args: argparse.Namespace) -> int:
    remotes = Remotes()
    if args.command == "remote":
        if args.action == "list":
            _lines(f"{n}\t{t}" for n, t in sorted(remotes.all().items()))
        elif args.action == "add":
            remotes.add(args.name or "", args.target or "")
        else:
            remotes.remove(args.name or "")
        return 0
    root = discover() if args.store == "." else remotes.resolve(args.store)
    if root is None:
        raise StoreError("there is no store here or above")
    spark, user = session(), args.user or getpass.getuser()
    repo = Repository(spark, root)
    repo.resume(user)
    home = repo.branch
    if args.branch and args.branch != home:
        if repo.staged or repo.removed:
            raise StoreError(f"something is staged on {home}")
        repo.branch = args.branch
    match args.command:
        case "init":
            repo.init()
        case "add":
            repo.add(registry.reader_for(args.source, args.reader)(spark, args.source), args.existing)
            if args.message:
                print(repo.commit(args.message))
        case "rm":
            print(repo.remove_items(args.path))
        case "mv":
            print(repo.move(args.old, args.new))
        case "status":
            print(f"on {repo.branch}")
            for what, subs in repo.status().items():
                _lines(f"{what}: {sub}" for sub in subs)
        case "reset":
            repo.reset(*args.subjects)
        case "commit":
            print(repo.commit(args.message) or "nothing is staged")
        case "log":
            _lines(f"{commit[:12]} {message}" for commit, message in repo.log()[: args.n])
        case "show":
            found = repo.resolve(args.version)
            if found is None:
                raise StoreError("there is no version yet")
            entry = repo.entry(found)
            print(json.dumps(entry | {"pins": len(entry["pins"])}, indent=1))
        case "ls":
            _lines(row["path"] for row in catalog.streamed(catalog.under(repo.read(), args.path).select("path")))
        case "find":
            entities = dict(e.split("=", 1) for e in args.entities)
            entities |= {n: v for n, v in (("datatype", args.datatype), ("sub", args.sub)) if v}
            _lines(row["path"] for row in catalog.streamed(catalog.find(repo.read(args.version), **entities).select("path")))
        case "query":
            _query(repo, args)
        case "diff":
            found = repo.diff(args.a, args.b).orderBy("path")
            any_row = False
            for row in catalog.streamed(found):
                print(row["change"], row["path"])
                any_row = True
            return int(any_row and args.exit_code)
        case "branch":
            if args.name:
                repo.branch_off(args.name, args.version)
            else:
                _lines(("* " if b == repo.branch else "  ") + b for b in repo.branches())
        case "tag":
            repo.tag(args.name, args.version)
        case "switch":
            repo.switch(args.name)
        case "merge":
            print(repo.merge(args.other, prefer=args.prefer))
        case "revert":
            print(repo.revert(args.version))
        case "clone":
            repo.clone(registry.storage_uri(args.target), args.version)
        case "gc":
            _lines(repo.gc(args.older_than, not args.delete))
        case "validate":
            return _issues(registry.inspect(spark, args.source, args.reader))
        case "verify":
            source = registry.reader_for(args.source, args.reader)(spark, args.source)
            size = F.col("n_bytes") if "n_bytes" in source.columns else F.lit(None).cast("bigint")
            mine = F.col("n_bytes") if "n_bytes" in repo.read().columns else F.lit(None).cast("bigint")
            shape = lambda df, n: df.select("path", n.alias("n_samples"), F.lit(0.0).alias("checksum"))
            return _issues(verify.items(shape(source, size), shape(repo.read(), mine)))
        case "export":
            rows = repo.read(args.version)
            flat = rows.select(*[(F.to_json(F.struct(f"`{f.name}`")) if f.dataType.simpleString().startswith(("array", "map", "struct")) else F.col(f"`{f.name}`")).alias(f.name) for f in rows.schema])
            files.export_tables(flat, registry.storage_uri(args.target), "sub")
        case "migrate":
            print(repo.migrate(spark.read.parquet(args.source), args.dry_run))
        case "fsck":
            return _issues(repo.check())
    if args.command in STAGING and args.command not in ("status", "diff"):
        if args.command != "switch" and not (repo.staged or repo.removed):
            repo.branch = home
        repo.keep(user)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (ValueError, RuntimeError, KeyError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
