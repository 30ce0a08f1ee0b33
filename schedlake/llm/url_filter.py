"""URL filters: a trie over reversed host labels, with path tries at its nodes, shared with every task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from schedlake.llm.shared import lower_ascii

#: Bytes of rules in one broadcast trie; longer lists are matched in as many passes over the trie blocks as they need.
BLOCK_BYTES = 32 << 20
VERDICTS = ("allow", "block")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


class Trie:
    """Nodes are ``[children by label, path node or None]``; path nodes are ``[children by segment, tails]``.

    A path is cut at its slashes. Whole segments are edges; what follows the last slash of a rule is a tail, which fits
    any segment that begins with it. ``tails`` maps it to the number of the rule.
    """

    def __init__(self, rules: Iterable[tuple[int, str, str]]):
        self.root: list = [{}, None]
        for number, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}]
            at = node[1]
            *segments, tail = path.split("/")
            for segment in segments:
                at = at[0].setdefault(segment, [{}, {}])
            at[1].setdefault(tail, number)

    def find(self, host: str, path: str) -> int | None:
        """The rule with the most host labels, among those the one with the longest path."""
        node, segments, best = self.root, None, None
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                if segments is None:
                    segments = path.split("/")
                found = self._path(node[1], segments)
                best = best if found is None else found
        return best

    @staticmethod
    def _path(node: list, segments: list[str]) -> int | None:
        best = None
        for segment in segments:
            if node[1]:
                fits = [t for t in node[1] if segment.startswith(t)] if len(node[1]) <= len(segment) else [
                    segment[:n] for n in range(len(segment) + 1) if segment[:n] in node[1]]
                if fits:
                    best = node[1][max(fits, key=len)]
            node = node[0].get(segment)
            if node is None:
                break
        return best


def with_url_parts(pages: DataFrame, url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url as columns; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return host, path


def resolved(rules: Iterable[Rule]) -> list[Rule]:
    """Distinct rules, block before allow where both name the same host and path."""
    kept: dict[tuple[str, str], Rule] = {}
    for rule in rules:
        if rule.verdict not in VERDICTS:
            raise ValueError(f"verdict {rule.verdict!r}: allow or block")
        key = (rule.host.translate({ord("A") + i: ord("a") + i for i in range(26)}), rule.path)
        if key not in kept or rule.verdict == "block":
            kept[key] = Rule(rule.verdict, *key)
    return list(kept.values())


def _blocks(rules: list[Rule], most: int) -> list[list[tuple[int, str, str]]]:
    blocks, held = [[]], 0
    for number, rule in enumerate(rules):
        size = len(rule.host) + len(rule.path) + 64
        if blocks[-1] and held + size > most:
            blocks.append([])
            held = 0
        blocks[-1].append((number, rule.host, rule.path))
        held += size
    return blocks


def judge(pages: DataFrame, rules: Iterable[Rule], page_id: str = "page_id", url: str = "url", default: str = "allow",
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per row of pages.

    A rule fits its host and all subdomains if the path begins with the rule's path. Of the fitting rules the one with
    the most host labels wins, then the one with the longest path, then block. ``rule`` is host and path of the winner;
    null where none fits, and the verdict is then ``default``. A null url has an empty host and path, so only a rule
    with an empty host could fit it. Rows that repeat are judged one by one, other columns are not read, and a list
    without rules gives ``default`` everywhere.
    """
    kept = sorted(resolved(rules), key=lambda r: (r.host.count("."), len(r.path)))
    context = pages.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in _blocks(kept, block_bytes)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(blocks[0].value) if len(blocks) == 1 else None
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            best: list[int | None] = [None] * len(hosts)
            for block in blocks:  # a later block holds rules of higher precedence
                find = (trie or Trie(block.value)).find
                best = [b if (f := find(h, p)) is None else f for b, h, p in zip(best, hosts, paths)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(best, pa.int32())],
                names=[page_id, "host", "path", "number"])

    host, path = with_url_parts(pages, url)
    kind = pages.schema[page_id].dataType.simpleString()
    found = pages.select(page_id, host.alias("host"), path.alias("path")).mapInArrow(
        scan, f"`{page_id}` {kind}, host string, path string, number int")
    names = pages.sparkSession.createDataFrame(
        [(i, r.host + r.path, r.verdict) for i, r in enumerate(kept)], "number int, rule string, verdict string")
    return found.join(names, "number", "left").select(
        page_id, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
