"""URL filters by a sort-merge range join of reversed-host keys.

A host is keyed by its labels in reverse (`www.example.net` -> `net.example.www.`), so a rule
for a host is a key prefix, that is an interval that holds the host and all its subdomains.
Pages are range-partitioned and sorted by key; a sweep over each sorted partition keeps the
stack of rule hosts whose interval is open, and each open host looks up the longest of its path
prefixes. The longest fitting rule (host plus path, then host) decides, else the default.

Cases: a null url or one without `://` has empty host and path and gets the default; equal rows
each get a row; rules with an empty host fit every host; of equal rules with several verdicts the
smallest verdict holds; an empty rule table leaves the default; further columns of pages are
dropped, so their names never clash.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import partitions

#: Rules that one sweep holds in memory; a larger rule table is swept in blocks of about this size.
RULES_PER_SWEEP = 500_000


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every row."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))


class _Sweep:
    """The open rule hosts along ascending keys."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.nodes: dict[str, tuple[str, dict[str, str]]] = {}
        for host, path, verdict in sorted(rules, reverse=True):
            self.nodes.setdefault(host_key(host), (host, {}))[1][path] = verdict
        self.keys = sorted(self.nodes)
        self.lengths = {k: sorted({len(p) for p in v[1]}, reverse=True) for k, v in self.nodes.items()}
        self.at, self.stack, self.last = -1, [], ""

    def move(self, key: str) -> None:
        if self.at < 0 or key < self.last:  # first row: open what began before this partition
            self.at = bisect_right(self.keys, key)
            self.stack = [key[:i] for i in range(len(key) + 1) if (i == 0 or key[i - 1] == ".") and key[:i] in self.nodes]
        while self.at < len(self.keys) and self.keys[self.at] <= key:
            begin = self.keys[self.at]
            while self.stack and not begin.startswith(self.stack[-1]):
                self.stack.pop()
            self.stack.append(begin)
            self.at += 1
        while self.stack and not key.startswith(self.stack[-1]):
            self.stack.pop()
        self.last = key

    def best(self, path: str):
        found, size = (None, None), (-1, -1)
        for key in reversed(self.stack):
            host, paths = self.nodes[key]
            for n in self.lengths[key]:
                if (n + len(host), len(host)) <= size:
                    break
                if n <= len(path) and path[:n] in paths:
                    found, size = (host + path[:n], paths[path[:n]]), (n + len(host), len(host))
                    break
        return found, size


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", per_sweep: int = RULES_PER_SWEEP) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages; rules has host, path, verdict."""
    spark = pages.sparkSession
    n = rules.count()
    blocks = max(1, -(-n // per_sweep))
    # sorted once; page_id in the range key splits a host that holds many rows
    key = F.when(F.col("host") == "", "").otherwise(
        F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    )
    out = (
        split_url(pages)
        .withColumns({"k": key, "rule": F.lit(None).cast("string"), "verdict": F.lit(default), "size": F.lit(-1), "hsize": F.lit(-1)})
        .repartitionByRange(partitions(spark), "k", "page_id")
        .sortWithinPartitions("k")
    )
    schema = out.schema
    block = F.pmod(F.xxhash64("host", "path"), F.lit(blocks))
    clean = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    for b in range(blocks):
        held = [tuple(r) for r in clean.where(block == b).dropDuplicates().collect()]  # at most about per_sweep rows

        def sweep(batches, held=held):
            state = _Sweep(held)
            for batch in batches:
                cols = {k: batch.column(k).to_pylist() for k in ("k", "path", "rule", "verdict", "size", "hsize")}
                for i, (k, path) in enumerate(zip(cols["k"], cols["path"])):
                    if i == 0 or k != state.last or state.at < 0:
                        state.move(k)
                    (rule, verdict), (size, hsize) = state.best(path)
                    if (size, hsize) > (cols["size"][i], cols["hsize"][i]):
                        cols["rule"][i], cols["verdict"][i], cols["size"][i], cols["hsize"][i] = rule, verdict, size, hsize
                new = {k: pa.array(v, batch.schema.field(k).type) for k, v in cols.items()}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

        out = out.mapInArrow(sweep, schema)
    return out.select("page_id", "host", "path", "rule", "verdict")
