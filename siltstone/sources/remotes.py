"""Names for stores, and finding the store that a folder belongs to."""

from __future__ import annotations

import json
import os
import re

from siltstone.sources import registry


class UnknownRemote(KeyError):
    """There is no remote of that name."""


class Remotes:
    """Named stores in a JSON file of the user's."""

    def __init__(self, path: str = "~/.siltstone/remotes.json"):
        self.path = os.path.expanduser(path)

    def all(self) -> dict[str, str]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path, encoding="utf-8") as file:
            return json.load(file)

    def _save(self, remotes: dict[str, str]) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.path + ".new", "w", encoding="utf-8") as file:
            json.dump(remotes, file, indent=1, sort_keys=True)
        os.replace(self.path + ".new", self.path)

    def add(self, name: str, target: str) -> None:
        """A new name; addresses with credentials are refused, as everywhere."""
        remotes = self.all()
        if name in remotes:
            raise ValueError(f"{name} exists")
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise ValueError(f"{name!r} isn't a name")
        self._save(remotes | {name: registry.storage_uri(target)})

    def remove(self, name: str) -> None:
        remotes = self.all()
        if name not in remotes:
            raise UnknownRemote(name)
        self._save({n: t for n, t in remotes.items() if n != name})

    def resolve(self, target: str) -> str:
        """A remote's address, name/below included; what no name begins is an address itself."""
        name, slash, below = target.partition("/")
        known = self.all()
        return known[name] + slash + below if name in known else registry.storage_uri(target)


def discover(start: str = ".") -> str | None:
    """The nearest folder, from ``start`` upward, that is a store."""
    at = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(at, "refs")) and os.path.isdir(os.path.join(at, "log")):
            return at
        above = os.path.dirname(at)
        if above == at:
            return None
        at = above
