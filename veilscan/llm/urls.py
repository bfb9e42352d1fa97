"""URL filters: rules on a host and a path prefix, found by a sort-merge range join.

A url's canonical key is its host with the labels reversed, a slash, and its path (``com.example.www//en/1``); a rule's
key is made in the same way, so all keys that a rule's host and path prefix fit form an interval of the sorted keys.
Since a rule also fits the subdomains of its host, a url stands in the order once for each number of labels that rules
have (``com//en/1``, ``com.example//en/1``, ...), and once under its whole host.

Urls and rules are sorted together by range partitions. A sweep over a partition keeps a stack of the rules whose
interval is open; they are nested, so the top one is the longest that fits. What is open where a partition starts
follows from a summary of one row per partition. A row number ends the order, so neither a hot host nor a hot url
falls into one partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A rule in an order: where it stands, and what it says.
_ENTRY = ("key", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and the path (from
    there up to ``?``, ``#`` or the end); both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(labels: Column, path: Column) -> Column:
    # hosts hold no slash, so the first one ends the host
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def _sorted(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (kind 0) and urls (kind 1) in order of their keys; a url's own row also holds page_id, host and path."""
    text = lambda c: F.coalesce(c, F.lit(""))
    of_rules = rules.select(text(F.translate("host", UPPER, UPPER.lower())).alias("host"), text(F.col("path")).alias("path"), text(F.col("verdict")).alias("verdict"))
    once = of_rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    depths = [r[0] for r in once.select(F.size(_labels(F.col("host"))).alias("n")).distinct().orderBy("n").collect()]  # a host has at most 127 labels
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"row": F.monotonically_increasing_id(), "_l": _labels(F.col("host"))})
    level = lambda labels, own: F.struct(_key(labels, F.col("path")).alias("key"), F.lit(own).alias("own"))
    levels = F.array(level(F.col("_l"), True), *[F.when(F.size("_l") > n, level(F.slice("_l", 1, n), False)) for n in depths])
    each = urls.select("row", "page_id", "host", "path", F.explode(F.array_compact(levels)).alias("_e"))
    own = lambda c: F.when(F.col("_e.own"), F.col(c)).alias(c)
    both = each.select("_e.key", F.lit(1).alias("kind"), "row", "_e.own", own("page_id"), own("host"), own("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).union(
        once.select(_key(_labels(F.col("host")), F.col("path")), F.lit(0), F.lit(None).cast("long"), F.lit(False), F.lit(None).cast("long"), "host", "path", F.concat("host", "path"), "verdict")
    )
    return in_order(both, "key", "kind", "row")


def _step(stack: list[tuple], key: str) -> None:
    """Closes the rules whose interval ends before ``key``."""
    while stack and not key.startswith(stack[-1][0]):
        stack.pop()


def _open_at_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its number, first key, last key, and its own rules that are open at the last key."""
    stack, part, first, last = [], None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if part is None:
            part, first = batch.column("_part")[0].as_py(), batch.column("key")[0].as_py()
        last = batch.column("key")[batch.num_rows - 1].as_py()
        rules = batch.filter(pc.equal(batch.column("kind"), 0))
        for entry in zip(*[rules.column(c).to_pylist() for c in _ENTRY], strict=True):
            _step(stack, entry[0])
            stack.append(entry)
        _step(stack, last)
    if part is not None:
        yield pa.RecordBatch.from_pylist([{"_part": part, "first": first, "open": [dict(zip(_ENTRY, e, strict=True)) for e in stack]}], _SUMMARY)


_SUMMARY = pa.schema([("_part", pa.int64()), ("first", pa.string()), ("open", pa.list_(pa.struct([(c, pa.string()) for c in _ENTRY])))])


def _carried(ordered: DataFrame) -> dict[int, list[tuple]]:
    """For each partition the rules of earlier ones that are open at its first key: at most one row per partition,
    with as many rules as are nested in each other there."""
    rows = ordered.select("_part", "key", "kind", "rule", "verdict").mapInArrow(_open_at_end, "_part long, first string, open array<struct<key:string,rule:string,verdict:string>>")
    stack, out = [], {}
    for r in sorted(rows.collect(), key=lambda r: r["_part"]):
        _step(stack, r["first"])
        out[r["_part"]] = list(stack)
        # what this partition opened lies inside what it was given, as far as that is still open
        stack = [e for e in stack if not r["open"] or r["open"][-1]["key"].startswith(e[0])] + [tuple(e) for e in r["open"]]
    return out


def _swept(sent):
    """Every url's own row, and those of its other rows that a rule fits, with the longest such rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if stack is None:
                stack = list(sent.value.get(batch.column("_part")[0].as_py(), []))
            keys, kinds, owns, rules, verdicts = (batch.column(c).to_pylist() for c in ("key", "kind", "own", "rule", "verdict"))
            kept, found = [], []
            for i, key in enumerate(keys):
                _step(stack, key)
                if kinds[i] == 0:
                    stack.append((key, rules[i], verdicts[i]))
                elif owns[i] or stack:
                    kept.append(i)
                    found.append(stack[-1] if stack else (None, None, None))
            own = batch.take(pa.array(kept, pa.int64()))
            out = [own.column(c) for c in ("row", "page_id", "host", "path")] + [pa.array([f[k] for f in found], pa.string()) for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays(out, ["row", "page_id", "host", "path", "key", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that decides, else null) and verdict of every row of
    ``pages`` (page_id, url).

    ``rules`` has host, path and verdict. A rule fits its host and all its subdomains if the url's path starts with
    the rule's. The longest rule (characters of host and path) decides, of equally long ones that with the longer
    host; where none fits, ``default`` does. Of rules with the same host and path the verdict last in the alphabet
    counts (``block`` over ``allow``). Urls that are null or have no ``://`` have an empty host and path. Rows are
    kept one for one, null and repeated ids included; an empty table gives no rows, and nulls in rules count as empty.
    """
    ordered = _sorted(pages, rules)
    carried = _carried(ordered)
    sent = ordered.sparkSession.sparkContext.broadcast(carried)
    rows = ordered.mapInArrow(_swept(sent), "row long, page_id long, host string, path string, key string, rule string, verdict string")
    best = F.struct(F.length("rule").alias("n"), F.length("key").alias("_"), F.instr("key", "/").alias("at"), F.col("rule"), F.col("verdict"))
    judged = rows.groupBy("row").agg(F.max("page_id").alias("page_id"), F.max("host").alias("host"), F.max("path").alias("path"), F.max(F.when(F.col("rule").isNotNull(), best)).alias("_best"))
    return judged.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
