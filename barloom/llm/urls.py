"""URL filter over a sorted digest array.

The rules are written to one file: 64-bit xxhash keys in order, where each rule's text ends, the
verdicts, and the texts. Executors fetch the file once, map it into memory and probe it by binary
search, a batch of urls at a time. A key found counts only if the full text of its rule is the one
looked for.

A rule is a host and a path, as in ``example.com/en/``. It fits urls of the host and its subdomains
whose path starts with the rule's. Only prefixes and suffixes of lengths that rules have are looked
up. Of the rules that fit the longest wins, of two equally long ones the one with the longer host.
"""

from __future__ import annotations

import functools
import json
import uuid

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii
from barloom.session import shared_folder

ALLOW, BLOCK = "allow", "block"
PART = 1 << 20


@dataclass(frozen=True)
class UrlRules:
    """A rule file by its name among the files that Spark sends to executors, and the lengths
    (host, path) that its rules have. ``otherwise``: the verdict without a rule."""

    name: str
    shapes: tuple[tuple[int, int], ...]
    otherwise: str = ALLOW


@dataclass(frozen=True)
class DigestArray:
    keys: np.ndarray
    ends: np.ndarray
    blocked: np.ndarray
    texts: np.ndarray

    def rule(self, i: int) -> str:
        start = int(self.ends[i - 1]) if i else 0
        return self.texts[start : int(self.ends[i])].tobytes().decode()

    def find(self, wanted: list[str]) -> np.ndarray:
        """Index of each text among the rules, or -1."""
        keys = np.array([xxhash.xxh64_intdigest(w) for w in wanted], dtype=np.uint64)
        at = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(at < len(self.keys))
        hit = hit[self.keys[at[hit]] == keys[hit]]
        found = np.full(len(wanted), -1, dtype=np.int64)
        for i in hit.tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.rule(j) == wanted[i]:
                    found[i] = j
                    break
                j += 1
        return found


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def pack_rules(rules: Iterable[tuple[str, str]]) -> bytes:
    """The rule file: a line of JSON, then the four arrays. A rule given twice keeps its last verdict."""
    last = {rule: verdict for rule, verdict in rules}
    rows = sorted((xxhash.xxh64_intdigest(r), r, v) for r, v in last.items())
    texts = [r.encode() for _, r, _ in rows]
    head = json.dumps({"rules": len(rows)}).encode() + b"\n"
    head = head.rjust(-(-len(head) // 8) * 8)
    return b"".join(
        [
            head,
            np.array([k for k, _, _ in rows], dtype=np.uint64).tobytes(),
            np.cumsum([len(t) for t in texts], dtype=np.uint64).tobytes(),
            np.array([v == BLOCK for _, _, v in rows], dtype=np.uint8).tobytes(),
            b"".join(texts),
        ]
    )


@functools.lru_cache(maxsize=4)
def mapped(path: str) -> DigestArray:
    with open(path, "rb") as file:
        head = file.readline()
    n, at = json.loads(head)["rules"], len(head)
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    return DigestArray(
        raw[at : at + 8 * n].view(np.uint64),
        raw[at + 8 * n : at + 16 * n].view(np.uint64),
        raw[at + 16 * n : at + 17 * n],
        raw[at + 17 * n :],
    )


def publish_rules(
    spark: SparkSession, rules: Iterable[tuple[str, str]], otherwise: str = ALLOW
) -> UrlRules:
    """Write the rule file to the shared folder and have Spark send it to every executor."""
    rules = list(rules)
    data, name = pack_rules(rules), f"url-rules-{uuid.uuid4().hex}.bin"
    target = f"{shared_folder(spark)}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    for start in range(0, len(data), PART):
        out.write(bytearray(data[start : start + PART]))
    out.close()
    spark.sparkContext.addFile(target)
    shapes = {tuple(map(len, split_rule(rule))) for rule, _ in rules}
    return UrlRules(name, tuple(sorted(shapes, key=lambda s: (sum(s), s[0]))), otherwise)


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty if the url is null or has no ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: UrlRules) -> Column:
    """Struct of the rule that wins, or null, and the verdict."""

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        array = mapped(SparkFiles.get(rules.name))
        best = np.full(len(hosts), -1, dtype=np.int64)
        pairs = list(zip(hosts, paths))
        for wide, deep in rules.shapes:
            rows, wanted = [], []
            for i, (h, p) in enumerate(pairs):
                edge = len(h) - wide
                if len(p) >= deep and (edge == 0 or edge > 0 and h[edge - 1] == "."):
                    rows.append(i)
                    wanted.append(h[edge:] + p[:deep])
            found = array.find(wanted)
            best[np.array(rows, dtype=np.int64)[found >= 0]] = found[found >= 0]
        names = [array.rule(i) if i >= 0 else None for i in best.tolist()]
        said = [rules.otherwise if i < 0 else BLOCK if array.blocked[i] else ALLOW for i in best.tolist()]
        return pd.DataFrame({"rule": pd.Series(names, dtype=object), "verdict": said})

    return judge(host, path)


def judge_pages(pages: DataFrame, rules: UrlRules) -> DataFrame:
    """``pages`` with host, path, rule and verdict of each url.

    A null url, or one without ``://``, has an empty host and path, which no rule with a host fits.
    Rows stand alone, so repeated rows and urls repeat their results; input columns of the same
    names are replaced.
    """
    host, path = url_parts()
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*[F.col(f"`{c}`") for c in names], host.alias("host"), path.alias("path"))
    judged = parts.withColumn("__judged", fitting_rule(F.col("host"), F.col("path"), rules))
    return judged.select(*[F.col(f"`{c}`") for c in names], "host", "path", "__judged.rule", "__judged.verdict")


def url_verdicts(pages: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    published = publish_rules(pages.sparkSession, rules)
    return judge_pages(pages.select("page_id", "url"), published).drop("url")
