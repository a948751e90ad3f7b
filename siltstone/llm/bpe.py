"""Byte-level BPE by prefix dynamic programming, with exact appends, edits and decoding.

For every prefix of a piece there is exactly one token that the merge order leaves last. The table of
those tokens is filled from left to right: a token that ends at i is the last token of prefix i iff it
starts the piece, or it can stand after the last token of the prefix it leaves. So appending bytes
only extends the table, and cutting the piece anywhere gives the exact encoding of what is left.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siltstone.llm.common import batches_of, bound_batches, free_name

#: Entries of a worker's cache of encoded chunks (the ids of each as text); it is emptied when full.
CACHE_ENTRIES = 500_000

#: Pieces up to this many bytes are encoded side by side in arrays, longer ones alone.
SIDE_BY_SIDE = 64

#: Bits of the hashed table of known token pairs (2^20 entries, 9 MB).
PAIR_BITS = 20


# Fixed value: the public pattern under which a lone space always begins a match and letters are one.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Trie:
    """The tokens as a trie in arrays: node -> token, node -> row of its children, row x byte -> node."""

    def __init__(self, ranks: dict[bytes, int]):
        nodes: dict[bytes, int] = {b"": 0}
        for token in ranks:
            for end in range(1, len(token) + 1):
                nodes.setdefault(token[:end], len(nodes))
        self.token = np.full(len(nodes), -1, np.int64)
        self.row = np.full(len(nodes), -1, np.int64)
        parents = list(dict.fromkeys(nodes[p[:-1]] for p in nodes if p))
        self.row[parents] = np.arange(len(parents))
        self.step = np.zeros((len(parents), 256), np.int32)
        for prefix, node in nodes.items():
            if prefix:
                self.step[self.row[nodes[prefix[:-1]]], prefix[-1]] = node
            if prefix in ranks:
                self.token[node] = ranks[prefix]
        self.first = self.step[self.row[0]] if len(parents) else np.zeros(256, np.int32)


class PrefixCoder:
    """Encodes pieces (byte strings) and texts under one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.inside = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.inside.add_word(token.decode("latin-1"), (len(token), rank))
        self.inside.make_automaton()
        found = regex.compile(pattern)
        # Whole matches, whatever groups a pattern has.
        self.find = found.findall if not found.groups else lambda text: [m[0] for m in found.finditer(text)]
        self.spaced = pattern == SPACED
        self._halves: dict[int, tuple[int, int]] = {}
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, str] = {}
        self._decimal = {rank: str(rank) for rank in self.tokens}
        self.trie = Trie(ranks)
        self.sizes = np.zeros(max(self.tokens, default=0) + 1, np.int64)
        self.sizes[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        # Every pair of tokens whose bytes together are a token, and that token's rank.
        met = sorted((ranks[t[:k]] << 24 | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self._met_key, self._met_rank = np.array(met or [(-1, 0)], np.int64).T.copy()
        self._left, self._right = np.full((2, len(self.sizes)), -1, np.int64)  # halves, filled as they are asked for
        self._pair_key = np.full(1 << PAIR_BITS, -1, np.int64)
        self._pair_good = np.zeros(1 << PAIR_BITS, bool)

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; a single byte is (token, token)."""
        found = self._halves.get(token)
        if found is None:
            whole = self.tokens[token]
            found = (token, token)
            if len(whole) > 1:
                parts = self._merged(whole, below=token)
                if len(parts) != 2:
                    raise ValueError(f"no two tokens merge into token {token}")
                found = (parts[0], parts[1])
            self._halves[token] = found
        return found

    def _merged(self, piece: bytes, below: int) -> list[int]:
        """``piece`` after all merges of a rank under ``below``, in merge order."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [self.ranks.get(parts[i] + parts[i + 1], below) for i in range(len(parts) - 1)]
            low = min(ranked)
            if low >= below:
                break
            at = ranked.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _apart(self, left: int, right: int) -> bool:
        """Whether the merge order leaves ``left`` and ``right`` apart when their bytes meet.

        Undo the later of the two merges step by step; the pair is broken if, at some step, the tokens
        that touch at the border would have merged before the next merge to be undone happened.
        """
        tokens, ranks = self.tokens, self.ranks
        a, b = left, right
        before = 1 << 62  # a border merge of this rank or later comes too late
        while True:
            met = ranks.get(tokens[a] + tokens[b])
            if met is not None and met < before:
                return False
            la, lb = len(tokens[a]) > 1, len(tokens[b]) > 1
            if not la and not lb:
                return True
            # The younger merge is undone first. On equal ranks the left one was made first, so the right one is younger.
            if la and (not lb or a > b):
                before, a = a, self.halves(a)[1]
                # A border merge of the same rank would begin after this merge's place: it would have come second.
            else:
                before, b = b + 1, self.halves(b)[0]
                # One of the same rank would begin before this merge's place: it would have come first.

    def prefix_table(self, piece: bytes, table: list[int] | None = None) -> list[int]:
        """table[i] is the last token of the encoding of piece[:i + 1]; a given table is extended in place."""
        table = [] if table is None else table
        done, known, apart = len(table), self._fits, self._apart
        since = max(0, done + 1 - self.longest)
        table += [-1] * (len(piece) - done)
        # All tokens that lie in the piece, by their last byte, the longest first.
        for last, (length, token) in self.inside.iter(piece[since:].decode("latin-1")):
            last += since
            if table[last] < 0:
                before = last - length
                if before >= 0:
                    pair = table[before] << 24 | token
                    good = known.get(pair)
                    if good is None:
                        good = known[pair] = apart(table[before], token)
                    if not good:
                        continue
                table[last] = token
        if len(known) > 4 * CACHE_ENTRIES:
            known.clear()
        return table

    def walk(self, table: list[int]) -> list[int]:
        """The encoding that a prefix table stands for, read from its end."""
        ids, at = [], len(table)
        while at:
            ids.append(table[at - 1])
            at -= len(self.tokens[table[at - 1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        return [token] if token is not None else self.walk(self.prefix_table(piece))

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.find(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def chunks(self, text: str) -> list[str]:
        """``text`` cut where a match surely begins, into strings that recur and can be remembered.

        A space without white space beside it always begins a match, so a text without double or trailing
        spaces is cut before every space; any other text is cut into its matches. A match taken alone
        matches whole again, so both kinds of chunk split the same way alone as in their text. That holds
        for SPACED; under another pattern the chunks are the matches, and each is one piece.
        """
        if not text:
            return []
        if not self.spaced:
            return self.find(text)
        if "  " in text or text[-1] == " ":
            return self.find(text)
        head, *rest = text.split(" ")
        return ([head] if head else []) + [" " + c for c in rest]

    def remember(self, chunks: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """(ids as text, their number, their bytes) of every one of ``chunks``."""
        known = self.ids_of(chunks)
        ids = {c: [int(i) for i in known[c].split(",")] if c else [] for c in chunks}
        return {c: (known[c], len(i), self.decode(i)) for c, i in ids.items()}

    def ids_of(self, chunks: set[str]) -> dict[str, str]:
        """The cache, with every one of ``chunks`` in it: its ids as text, which decode to its very bytes."""
        cache, words, tokens, ranks = self._cache, self._decimal, self.tokens, self.ranks
        new = chunks.difference(cache)
        if len(cache) + len(new) > CACHE_ENTRIES:
            cache.clear()
            new = chunks
        todo, pieces, counts = [], [], []
        for chunk in new:
            # isalpha is \\p{L}+, so such a chunk is one match
            if not self.spaced or chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
                data = chunk.encode()
                token = ranks.get(data)
                if token is not None:
                    if tokens[token] != data:
                        raise ValueError(f"token {token} decodes to other bytes")
                    cache[chunk] = words[token]
                    continue
                pieces.append(data)
                counts.append(1)
            else:
                found = self.find(chunk)
                pieces += [p.encode() for p in found]
                counts.append(len(found))
            todo.append(chunk)
        encoded = self.encode_many(pieces)
        at = 0
        for chunk, count in zip(todo, counts, strict=True):
            ids = encoded[at] if count == 1 else [i for piece in encoded[at : at + count] for i in piece]
            at += count
            if b"".join([tokens[i] for i in ids]) != chunk.encode():
                raise ValueError(f"the ids of {chunk!r} decode to other bytes")
            cache[chunk] = ",".join([words[i] for i in ids])
        return cache

    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """encode_piece of many pieces, their prefix tables filled side by side."""
        out: list[list[int] | None] = [[t] if (t := self.ranks.get(p)) is not None else None for p in pieces]
        todo = [k for k, ids in enumerate(out) if ids is None and 0 < len(pieces[k]) <= SIDE_BY_SIDE]
        for start in range(0, len(todo), 20_000):
            part = todo[start : start + 20_000]
            for k, ids in zip(part, self._side_by_side([pieces[k] for k in part]), strict=True):
                out[k] = ids
        return [self.walk(self.prefix_table(p)) if ids is None else ids for p, ids in zip(pieces, out, strict=True)]

    def _side_by_side(self, pieces: list[bytes]) -> list[list[int]]:
        lengths = np.array([len(p) for p in pieces], np.int64)
        buffer = np.frombuffer(b"".join(pieces), np.uint8)
        begins = np.cumsum(lengths) - lengths
        piece_of = np.repeat(np.arange(len(pieces)), lengths)
        offset = np.arange(len(buffer)) - begins[piece_of]
        # Every token inside every piece: all positions walk down the trie of tokens together.
        trie = self.trie
        at, left = np.arange(len(buffer)), (lengths[piece_of] - offset)
        node = trie.first[buffer]
        hits_at, hits_len, hits_token, depth = [], [], [], 1
        while len(at):
            token = trie.token[node]
            hit = token >= 0
            hits_at.append(at[hit])
            hits_len.append(np.full(int(hit.sum()), depth))
            hits_token.append(token[hit])
            row = trie.row[node]
            on = (row >= 0) & (left > depth)
            at, left, row = at[on], left[on], row[on]
            node = trie.step[row, buffer[at + depth]]
            on = node > 0
            at, left, node = at[on], left[on], node[on]
            depth += 1
        start, size, token = np.concatenate(hits_at), np.concatenate(hits_len), np.concatenate(hits_token)
        last = start + size - 1
        order = np.argsort(offset[last].astype(np.int16), kind="stable")
        start, last, token = start[order], last[order], token[order]
        edges = np.searchsorted(offset[last], np.arange(int(lengths.max()) + 1))
        table = np.full(len(buffer), -1, np.int64)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            s, e, t = start[lo:hi], last[lo:hi], token[lo:hi]
            inner = offset[s] > 0
            table[e[~inner]] = t[~inner]
            s, e, t = s[inner], e[inner], t[inner]
            # A whole prefix that is a token is the prefix's only token.
            open_ = table[e] < 0
            s, e, t = s[open_], e[open_], t[open_]
            good = self._pairs(table[s - 1] << 24 | t)
            table[e[good]] = t[good]
        # Read the tables from their ends.
        size_of = self.sizes
        which, at = np.arange(len(pieces)), begins + lengths - 1
        read_piece, read_token = [], []
        while len(which):
            token = table[at]
            read_piece.append(which)
            read_token.append(token)
            at = at - size_of[token]
            on = at >= begins[which]
            which, at = which[on], at[on]
        piece, token = np.concatenate(read_piece[::-1]), np.concatenate(read_token[::-1])
        order = np.argsort(piece, kind="stable")
        flat, ends = token[order].tolist(), np.cumsum(np.bincount(piece, minlength=len(pieces))).tolist()
        return [flat[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]

    def _pairs(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the two tokens of each pair stand apart, by a table of answers kept by hash."""
        slot = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
        found = self._pair_key[slot] == pairs
        good = self._pair_good[slot] & found
        missed = np.flatnonzero(~found)
        if len(missed):
            asked, which = np.unique(pairs[missed], return_inverse=True)
            answer = self._apart_many(asked >> 24, asked & 0xFFFFFF)
            good[missed] = answer[which]
            # The last of those in one slot stays, key and answer alike.
            slot, last = np.unique(slot[missed][::-1], return_index=True)
            last = len(missed) - 1 - last
            self._pair_key[slot], self._pair_good[slot] = pairs[missed[last]], good[missed[last]]
        return good

    def _apart_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_apart of many pairs, undone side by side."""
        good = np.ones(len(left), bool)
        live, a, b, before = np.arange(len(left)), left, right, np.full(len(left), 1 << 62)
        while len(live):
            key = a << 24 | b
            at = np.minimum(np.searchsorted(self._met_key, key), len(self._met_key) - 1)
            bad = (self._met_key[at] == key) & (self._met_rank[at] < before)
            good[live[bad]] = False
            la, lb = self.sizes[a] > 1, self.sizes[b] > 1
            on = ~bad & (la | lb)
            live, a, b, la, lb = live[on], a[on], b[on], la[on], lb[on]
            undo = la & (~lb | (a > b))
            whole = np.where(undo, a, b)
            for token in np.unique(whole[self._left[whole] < 0]).tolist():
                self._left[token], self._right[token] = self.halves(token)
            before = np.where(undo, a, b + 1)
            a, b = np.where(undo, self._right[whole], a), np.where(undo, b, self._left[whole])
        return good


class EditableText:
    """A text with its encoding, re-encoded only around appends and edits."""

    def __init__(self, coder: PrefixCoder, text: str = ""):
        self.coder = coder
        self.pieces: list[str] = []
        self.ids: list[list[int]] = []
        self.append(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def encoding(self) -> list[int]:
        return [i for ids in self.ids for i in ids]

    def append(self, more: str) -> None:
        self.edit(sum(map(len, self.pieces)), 0, more)

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``at`` by ``inserted``.

        Matches look a bounded way ahead, so the pieces up to two before the edit stay; after it, as soon
        as a new match begins where an old one began, the old pieces and their tokens are kept.
        """
        starts = [0]
        for piece in self.pieces:
            starts.append(starts[-1] + len(piece))
        text = self.text
        new = text[:at] + inserted + text[at + removed :]
        first = max(0, int(np.searchsorted(starts, at, side="left")) - 3)
        old_after = {s - removed + len(inserted): k for k, s in enumerate(starts[:-1]) if s >= at + removed}
        pieces, ids, pos, kept = self.pieces[:first], self.ids[:first], starts[first] if first < len(starts) else 0, None
        for match in self.coder.find(new[pos:]):
            if pos > at + len(inserted) and pos in old_after:
                kept = old_after[pos]
                break
            pieces.append(match)
            ids.append(self.coder.encode_piece(match.encode()))
            pos += len(match)
        if kept is not None:
            pieces += self.pieces[kept:]
            ids += self.ids[kept:]
        self.pieces, self.ids = pieces, ids


_CODERS: dict[tuple[int, str], PrefixCoder] = {}


def coder_for(data: bytes, pattern: str) -> PrefixCoder:
    """This worker's coder for a rank file; built once, kept while the worker lives."""
    key = (hash(data), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = PrefixCoder(read_ranks(data), pattern)
    return _CODERS[key]


def encode_decode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and add what came out.

    Added columns: n_tokens long, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the
    decoded bytes), and with ``with_ids`` ids array<int>. A null text counts as empty: no tokens. Every
    other column of ``df`` is kept except ``text`` itself; names that clash get a leading underscore on
    the old column. Rows map one to one, so there is no shuffle; repeated rows give repeated results, an
    empty table gives an empty one. The rank file travels as a broadcast (under 1 MB, fixed).
    """
    spark = df.sparkSession
    bound_batches(spark)
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    for name in added:
        if name in df.columns:
            df = df.withColumnRenamed(name, free_name(df, "_" + name))
    kept = [c for c in df.columns if c != text]
    schema = df.select(*kept).schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")) + (("ids", "array<int>"),) * with_ids:
        schema = schema.add(name, _type(kind))
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(shared.value, pattern)
        for batch in batches:
            counts, shas, decoded, ids = [], [], [], []
            texts = [coder.chunks(value) for value in batches_of(batch.column(batch.schema.get_field_index(text)))]
            known = coder.ids_of(set().union(*texts)).__getitem__
            for chunks in texts:
                joined = ",".join(map(known, chunks))
                counts.append(joined.count(",") + 1 if joined else 0)
                shas.append(hashlib.sha256(joined.encode()).hexdigest())
                # Every chunk's ids were decoded to its own bytes, so all ids decode to those of all chunks.
                decoded.append(hashlib.sha256("".join(chunks).encode()).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added])

    return df.select(*kept, text).mapInArrow(run, schema)


def _type(kind: str):
    from pyspark.sql import types as T

    return {"long": T.LongType(), "string": T.StringType(), "array<int>": T.ArrayType(T.IntegerType())}[kind]
