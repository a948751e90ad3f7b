"""A versioned catalogue on shared storage: Parquet snapshots of subjects, and a log of commits.

A commit writes the touched subjects under a new snapshot folder, then one log entry, then the next
numbered entry of its branch, which is what makes it visible. That entry is created, never overwritten, so of
two writers that started from the same version one is told that the branch has moved on. Readers plan
against one entry, so they see a version whole. Entries are JSON files, read and written through Spark's
file systems; an entry of the log never changes and is read once.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import verify, versions

#: Column types of values that callers give.
_KINDS = {str: "string", int: "long", float: "double", bool: "boolean", bytes: "binary"}


class StoreError(RuntimeError):
    """The operation doesn't fit the store's state."""


def _of(rows: DataFrame, subs: set[str], owned: set[str]) -> DataFrame:
    """The rows of some subjects; all rows, without a filter, if a frame has no others."""
    return rows if owned and owned <= subs else rows.where(F.col("sub").isin(sorted(subs)))


class Repository:
    """Items by subject, with branches, tags and history."""

    def __init__(self, spark: SparkSession, root: str, branch: str = "main"):
        self.spark, self.root, self.branch = spark, root.rstrip("/"), branch
        #: Staged frames, and which of them has each staged subject's items.
        self._frames: list[DataFrame] = []
        self._owned: list[set[str]] = []
        self.staged: dict[str, int] = {}
        self.removed: set[str] = set()
        self._seen: str | None = None
        self._known: dict[str, dict] = {}

    # Files, by Hadoop's own API, so that any of its storages will do.
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def put(self, name: str, content: bytes, overwrite: bool = True) -> None:
        """Write one file below the root."""
        fs, path = self._fs(f"{self.root}/{name}")
        out = fs.create(path, overwrite)
        out.write(bytearray(content))
        out.close()

    def _write(self, name: str, value: dict, overwrite: bool = True) -> None:
        self.put(f"{name}.json", json.dumps(value).encode(), overwrite)

    def _read(self, name: str) -> dict | None:
        fs, path = self._fs(f"{self.root}/{name}.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        data = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        return json.loads(data)

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName().removesuffix(".json") for s in fs.listStatus(path)) if fs.exists(path) else []

    # History
    def commits(self) -> dict[str, dict]:
        return {n: self.entry(n) for n in self._names("log")}

    def entry(self, commit: str) -> dict:
        """A version's log entry: id, parents, message, ts and pins."""
        if commit not in self._known:
            self._known[commit] = self._read(f"log/{commit}")
        return self._known[commit]

    def _ref(self, kind: str, name: str) -> tuple[int, str | None]:
        """The number of a branch's or tag's last entry, and the version it names."""
        names = self._names(f"refs/{kind}-{name}")
        return (int(names[-1]), self._read(f"refs/{kind}-{name}/{names[-1]}")["id"]) if names else (-1, None)

    def _point(self, kind: str, name: str, commit: str, after: int) -> None:
        """Make the entry that follows entry ``after``; someone else having made it is a conflict."""
        try:
            self._write(f"refs/{kind}-{name}/{after + 1:012d}", {"id": commit}, overwrite=False)
        except Exception as error:
            if "already exists" in str(error):
                raise StoreError("the branch has moved on") from error
            raise

    def head(self) -> str | None:
        return self._ref("branch", self.branch)[1]

    def resolve(self, version: str | None = None) -> str | None:
        """A branch, tag, id, unique prefix of six or more signs, or REF~N."""
        if version is None:
            return self.head()
        name, mark, back = version.partition("~")
        found = next((r for kind in ("branch", "tag") if (r := self._ref(kind, name)[1])), None)
        if found is None:
            fits = [c for c in self._names("log") if c == name or (len(name) >= 6 and c.startswith(name))]
            if len(fits) != 1:
                raise StoreError(f"{'no' if not fits else 'more than one'} version {name!r}")
            found = fits[0]
        for _ in range(int(back or 1) if mark else 0):
            if not self.entry(found)["parents"]:
                raise StoreError(f"{version!r} lies before the first version")
            found = self.entry(found)["parents"][0]
        return found

    def log(self) -> list[tuple[str, str]]:
        """(id, message) of the branch, newest first."""
        out, at = [], self.head()
        while at:
            out.append((at, self.entry(at)["message"]))
            at = next(iter(self.entry(at)["parents"]), None)
        return out

    def read(self, version: str | None = None, include_staged: bool = False) -> DataFrame:
        """The items of a version, only the snapshots it pins; staged subjects in place of theirs, if asked."""
        at = self.resolve(version)
        pins = self.entry(at)["pins"] if at else {}
        if include_staged:
            pins = {s: p for s, p in pins.items() if s not in self.staged and s not in self.removed}
        by_pin: dict[str, set[str]] = {}
        for sub, pin in pins.items():
            by_pin.setdefault(pin, set()).add(sub)
        parts = [_of(self.spark.read.parquet(f"{self.root}/data/{pin}"), subs, self._within(pin)) for pin, subs in sorted(by_pin.items())]
        parts += self._staged_frames() if include_staged else []
        if not parts:
            return self.spark.createDataFrame([], "sub string, path string")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def _within(self, pin: str) -> set[str]:
        """The subjects that a snapshot was written with."""
        return {s for s, p in (self.entry(pin) or {"pins": {}})["pins"].items() if p == pin}

    def _staged_frames(self) -> list[DataFrame]:
        """One plan for each ingest, not for each subject."""
        live = [{s for s, k in self.staged.items() if k == n} for n in range(len(self._frames))]
        return [_of(frame, subs, owned) for frame, subs, owned in zip(self._frames, live, self._owned, strict=True) if subs]

    # Changes
    def add(self, items: DataFrame, existing: str = "error") -> None:
        """Stage whole subjects' items; paths already there are an error, skipped or replaced."""
        current = self.read(include_staged=True)
        if existing == "error":
            clash = items.join(current.select("path"), "path", "left_semi").limit(1).collect()
            if clash:
                raise StoreError(f"{clash[0]['path']} exists")
        elif existing == "skip":
            items = items.join(current.select("path"), "path", "left_anti")
        elif existing != "replace":
            raise StoreError("existing is error, skip or replace")
        touched = items.select("sub").distinct()
        rest = current.join(touched, "sub", "left_semi").join(items.select("path"), "path", "left_anti")
        staged = rest.unionByName(items, allowMissingColumns=True) if current.columns != ["sub", "path"] else items
        self._stage(staged, {row["sub"] for row in touched.collect()})  # subjects of one ingest

    def _stage(self, frame: DataFrame, subs: set[str]) -> None:
        """``frame`` holds all items of these subjects from now on."""
        self._frames.append(frame)
        self._owned.append(subs)
        self.staged |= dict.fromkeys(subs, len(self._frames) - 1)
        self.removed -= subs

    def remove(self, sub: str) -> None:
        self.staged.pop(sub, None)
        self.removed.add(sub)

    def remove_items(self, path: str) -> int:
        """Stage the removal of what is at or below a path; returns how many items go. None is an error."""
        now = self.read(include_staged=True)
        return self._rewritten(now, versions.without(now, path), path)

    def move(self, old: str, new: str) -> int:
        """Stage what is at or below a path under another, which must be free; the subject follows the path."""
        now = self.read(include_staged=True)
        if not versions.under(now, new).isEmpty():
            raise StoreError(f"{new} exists")
        return self._rewritten(now, versions.moved(now, old, new).withColumn("sub", F.split_part("path", F.lit("/"), F.lit(1))), old)

    def _rewritten(self, before: DataFrame, after: DataFrame, path: str) -> int:
        gone = versions.under(before, path)
        count = gone.count()
        if not count:
            raise StoreError(f"there is no {path}")
        left = {r["sub"] for r in gone.select("sub").distinct().collect()}
        entered = after.join(before.select("path"), "path", "left_anti")
        whole = left | {r["sub"] for r in entered.select("sub").distinct().collect()}
        frame = after.where(F.col("sub").isin(sorted(whole)))
        still = {r["sub"] for r in frame.select("sub").distinct().collect()}
        for sub in whole - still:
            self.remove(sub)
        if still:
            self._stage(frame, still)
        return count

    def add_items(self, sub: str, items: list[dict], existing: str = "error", schema: str | None = None) -> None:
        """Stage single items of a subject, given as dicts with a path below it and what else is known."""
        if not text.is_segment(sub):
            raise StoreError(f"{sub!r} isn't a valid subject")
        rows = [{"sub": sub} | item | {"path": "/".join([sub, item["path"]]) if item.get("path") else sub} for item in items]
        names = list(dict.fromkeys(n for row in rows for n in row))
        kinds = schema or ", ".join(f"`{n}` {_KINDS[type(next((r[n] for r in rows if r.get(n) is not None), ''))]}" for n in names)
        self.add(self.spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], kinds), existing)

    def create_subject(self, sub: str, **attributes) -> None:
        """Stage a new subject: an item of kind attrs at its own path."""
        self.add_items(sub, [{"path": "", "kind": "attrs"} | attributes])

    def add_derivative(self, pipeline: str, items: DataFrame, version: str = "", existing: str = "error") -> None:
        """Stage what a pipeline made of items: their paths below derivatives/PIPELINE of the subject, with
        the pipeline and the version that was read as provenance."""
        if not text.is_segment(pipeline):
            raise StoreError(f"{pipeline!r} isn't a valid name")
        rest = F.expr("substr(path, length(sub) + 2)")
        made = F.struct(F.lit(pipeline).alias("pipeline"), F.lit(version).alias("pipeline_version"), F.lit(self.head()).alias("source_version"), F.col("path").alias("source_path"))
        self.add(items.withColumn("generated_by", made).withColumn("path", F.concat_ws("/", "sub", F.lit("derivatives"), F.lit(pipeline), rest)), existing)

    def keep(self, user: str) -> None:
        """Write what is staged, and the branch, so that another session of the user goes on with it."""
        name = f"staging/{user}"
        kept = []
        for n, frame in enumerate(self._frames):
            subs = {s for s, k in self.staged.items() if k == n}
            if subs:
                part = f"{name}-{uuid.uuid4().hex}"
                _of(frame, subs, self._owned[n]).write.parquet(f"{self.root}/{part}")
                kept.append([part, sorted(subs)])
        before = self._read(name) or {"frames": []}
        self._write(name, {"branch": self.branch, "frames": kept, "removed": sorted(self.removed)})
        for part, _ in before["frames"]:
            fs, path = self._fs(f"{self.root}/{part}")
            fs.delete(path, True)

    def resume(self, user: str) -> None:
        """Take up what ``keep`` wrote."""
        state = self._read(f"staging/{user}")
        if state is None:
            return
        self.branch, self.removed = state["branch"], set(state["removed"])
        self.staged, self._frames, self._owned = {}, [], []
        for part, subs in state["frames"]:
            self._stage(self.spark.read.parquet(f"{self.root}/{part}"), set(subs))

    def check(self) -> DataFrame:
        """Issues of the branch's version: pins without a snapshot, subjects that their snapshot lacks, and
        pinned subjects that the items don't hold. Snapshots are read for their subjects only."""
        at = self.head()
        pins = self.entry(at)["pins"] if at else {}
        have = set(self._names("data"))
        manifest = self.spark.createDataFrame(sorted(pins.items()), "sub string, digest string")
        out = [verify.issues(manifest.where(~F.col("digest").isin(sorted(have))), F.lit(True), "no_snapshot", F.col("digest"), "sub")]
        index = self.spark.createDataFrame([], "sub string, digest string")
        for pin in sorted(set(pins.values()) & have):
            index = index.unionByName(self.spark.read.parquet(f"{self.root}/data/{pin}").select("sub").distinct().withColumn("digest", F.lit(pin)))
        out.append(verify.store(manifest.where(F.col("digest").isin(sorted(have))), index.join(manifest, ["sub", "digest"], "left_semi")))
        return verify.together(*out)

    def migrate(self, source: DataFrame, dry_run: bool = False) -> int:
        """Bring items without versions (sub, path and any others) in as the first version; how many they are.

        Nothing is written in a dry run; a store that has versions, a null subject or path and a repeated
        path are errors.
        """
        if self.head():
            raise StoreError("the store has versions")
        bad = source.where("sub IS NULL OR path IS NULL").unionByName(source.join(source.groupBy("path").count().where("count > 1"), "path", "left_semi")).limit(1).collect()
        if bad:
            raise StoreError(f"no subject, or a path that isn't one item's: {bad[0]['path']}")
        count = source.count()
        if not dry_run:
            self.add(source)
            self.commit("Migrate")
        return count

    def status(self) -> dict[str, list[str]]:
        return {"staged": sorted(self.staged), "removed": sorted(self.removed)}

    def reset(self, *subs: str) -> None:
        """Forget what is staged, of some subjects or of all."""
        for sub in subs or [*self.staged, *self.removed]:
            self.staged.pop(sub, None)
            self.removed.discard(sub)
        if not self.staged:
            self._frames, self._owned = [], []

    def commit(self, message: str, parents: list[str] | None = None, expected: str | None = None) -> str | None:
        """Publish what is staged; None if nothing is. A branch that moved on since is a conflict."""
        if not self.staged and not self.removed:
            return None
        number, head = self._ref("branch", self.branch)
        if expected is not None and head != expected:
            raise StoreError("the branch has moved on")
        pins = dict(self.entry(head)["pins"]) if head else {}
        new = uuid.uuid4().hex
        if self.staged:
            frames = self._staged_frames()
            out = frames[0]
            for f in frames[1:]:
                out = out.unionByName(f, allowMissingColumns=True)
            out.repartition("sub").sortWithinPartitions("sub", "path").write.parquet(f"{self.root}/data/{new}")
        pins |= dict.fromkeys(self.staged, new)
        return self._publish({s: p for s, p in pins.items() if s not in self.removed}, message, parents if parents is not None else [head] if head else [], number, new)

    def _publish(self, pins: dict[str, str], message: str, parents: list[str], number: int, new: str | None = None) -> str:
        """Make a version the one after entry ``number`` of the branch; what is staged stays so on a conflict."""
        new = new or uuid.uuid4().hex
        self._write(f"log/{new}", {"id": new, "parents": parents, "message": message, "ts": time.time(), "pins": pins}, overwrite=False)
        self._point("branch", self.branch, new, number)
        self.staged, self.removed, self._frames, self._owned = {}, set(), [], []
        return new

    def branch_off(self, name: str, version: str | None = None) -> None:
        if self._ref("branch", name)[1]:
            raise StoreError(f"branch {name} exists")
        self._point("branch", name, self.resolve(version), -1)

    def init(self) -> None:
        """Make an empty store; one that is there already is an error."""
        fs, path = self._fs(f"{self.root}/log")
        if fs.exists(path):
            raise StoreError(f"{self.root} is a store")
        for folder in ("log", "refs", "data"):
            fs, path = self._fs(f"{self.root}/{folder}")
            fs.mkdirs(path)

    def branches(self) -> list[str]:
        return [n.removeprefix("branch-") for n in self._names("refs") if n.startswith("branch-")]

    def switch(self, name: str) -> None:
        if self.staged or self.removed:
            raise StoreError("something is staged")
        if not self._ref("branch", name)[1]:
            raise StoreError(f"no branch {name}")
        self.branch = name

    def tag(self, name: str, version: str | None = None) -> None:
        if self._ref("tag", name)[1]:
            raise StoreError(f"tag {name} exists")
        self._point("tag", name, self.resolve(version), -1)

    def clone(self, root: str, version: str | None = None) -> Repository:
        """A copy of the store elsewhere: all of it, or (shallow) one version without what came before."""
        to = Repository(self.spark, root, self.branch)
        fs, source = self._fs(self.root)
        other, target = self._fs(to.root)
        if other.exists(target):
            raise StoreError(f"{root} exists")
        if version is None:
            jvm = self.spark.sparkContext._jvm
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, other, target, False, self.spark.sparkContext._jsc.hadoopConfiguration())
            return to
        rows = self.read(version)
        to._stage(rows, {r["sub"] for r in rows.select("sub").distinct().collect()})
        to.commit(f"Version {self.resolve(version)}")
        return to

    def diff(self, a: str | None = None, b: str | None = None) -> DataFrame:
        """Paths added, removed and changed from a to b; without b, to what is staged."""
        return versions.difference(self.read(a), self.read(b) if b is not None else self.read(include_staged=True))

    def _history(self, at: str) -> dict[str, int]:
        depth, front = {at: 0}, [at]
        while front:
            near = [(p, depth[c] + 1) for c in front for p in self.entry(c)["parents"]]
            front = []
            for p, d in near:
                if p not in depth:
                    depth[p] = d
                    front.append(p)
        return depth

    def merge(self, other: str, message: str | None = None, prefer: str | None = None) -> str:
        """Bring another branch's subjects here; a subject both changed is merged item by item."""
        theirs, (number, mine) = self.resolve(other), self._ref("branch", self.branch)
        own = self._history(mine)
        history = self._history(theirs)
        if theirs in own:
            return mine
        if mine in history:
            self._point("branch", self.branch, theirs, number)
            return theirs
        base = min((c for c in history if c in own), key=lambda c: history[c], default=None)
        old, a, b = (self.entry(base)["pins"] if base else {}), self.entry(mine)["pins"], self.entry(theirs)["pins"]
        pins, both, new = {}, [], None
        for sub in sorted(set(old) | set(a) | set(b)):
            if a.get(sub) == old.get(sub) or a.get(sub) == b.get(sub):
                pins[sub] = b.get(sub)
            elif b.get(sub) == old.get(sub):
                pins[sub] = a.get(sub)
            else:
                both.append(sub)
        if both:
            part = lambda v: self.read(v).where(F.col("sub").isin(both))
            found = versions.merge(part(base) if base else part(mine).limit(0), part(mine), part(theirs), prefer=prefer)
            new = uuid.uuid4().hex
            found.write.parquet(f"{self.root}/data/{new}")
            pins |= dict.fromkeys(both, new)
        return self._publish({s: p for s, p in pins.items() if p}, message or f"Merge {other}", [mine, theirs], number, new)

    def revert(self, version: str, message: str | None = None) -> str:
        """Undo one version's pins; refused for subjects that changed again since."""
        at, (number, head) = self.resolve(version), self._ref("branch", self.branch)
        after, parents = self.entry(at)["pins"], self.entry(at)["parents"]
        before = self.entry(parents[0])["pins"] if parents else {}
        pins = dict(self.entry(head)["pins"])
        for sub in set(before) | set(after):
            if before.get(sub) != after.get(sub):
                if pins.get(sub) != after.get(sub):
                    raise StoreError(f"{sub} changed after {version}")
                pins[sub] = before.get(sub)
        return self._publish({s: p for s, p in pins.items() if p}, message or f"Revert {version}", [head], number)

    def gc(self, older_than: float, dry_run: bool = True) -> list[str]:
        """Snapshots that no version before a branch or tag pins, written before ``older_than``.

        A snapshot without a log entry may be one that a commit is still writing: it is as old as its folder.
        """

        def written(snapshot: str) -> float:
            entry = self._read(f"log/{snapshot}")
            if entry:
                return entry["ts"]
            fs, path = self._fs(f"{self.root}/data/{snapshot}")
            return max(s.getModificationTime() for s in (fs.getFileStatus(path), *fs.listStatus(path))) / 1000

        live: set[str] = set()
        for ref in self._names("refs"):
            for c in self._history(self._ref(*ref.split("-", 1))[1]):
                live |= set(self.entry(c)["pins"].values())
        gone = [d for d in self._names("data") if d not in live and written(d) < older_than]
        for d in [] if dry_run else gone:
            fs, path = self._fs(f"{self.root}/data/{d}")
            fs.delete(path, True)
        return gone

    def refresh(self) -> bool:
        """Whether the branch has moved since the last call."""
        head, self._seen, before = self.head(), self.head(), self._seen
        return head != before

    def watch(self, interval: float = 2.0, timeout: float | None = None):
        """Each new version of the branch as it appears; versions between two looks count as the last."""
        began, seen = time.monotonic(), self.head()
        while timeout is None or time.monotonic() - began < timeout:
            head = self.head()
            if head != seen:
                seen = head
                yield head
            time.sleep(interval)
