"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches, the largest ids first. A batch's lines are reduced to one row per key
and merged against the runs of the batches before: keys that no run holds are the batch's own and
become a new sorted run (the anti-join), the others add to the counts of keys already held. When a
level has ``fan`` runs they are merged into one run of the next level, so a key is rewritten only
a logarithmic number of times. Every key lies in exactly one run, with the largest document that
holds it.

Keys are two 64-bit hashes of the line under different seeds. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import WHITE, document_key, lower_ascii, stored

KEY = ["h1", "h2"]


@dataclass(frozen=True)
class LineRule:
    """Lines whose key has ``min_chars`` code points or more and lies in ``min_docs`` documents
    or more stay in one document only. ``batches`` of documents, ``fan`` runs to a merge."""

    min_chars: int = 20
    min_docs: int = 3
    batches: int = 4
    fan: int = 2


@dataclass
class LineRuns:
    """Sorted runs by level; a level with ``fan`` runs is merged into one of the next level."""

    spark: SparkSession
    fan: int = 2
    levels: list[list[DataFrame]] = field(default_factory=list)

    def rows(self) -> DataFrame | None:
        """All keys held, each once."""
        found = None
        for run in (r for level in self.levels for r in level):
            found = run if found is None else found.unionByName(run)
        return found

    def against(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``fresh``: true where no run holds the key."""
        held = self.rows()
        if held is None:
            return keys.withColumn("fresh", F.lit(True))
        held = held.select(*KEY, F.lit(True).alias("held"))
        return keys.join(held, KEY, "left").select(
            *keys.columns, F.col("held").isNull().alias("fresh")
        )

    def add(self, run: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.unionByName(other)
            self.levels[level] = []
            self.add(sorted_run(merged), level + 1)


def sorted_run(keys: DataFrame) -> DataFrame:
    return stored(keys.repartitionByRange(*KEY).sortWithinPartitions(*KEY))


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def lines_of(text: str | Column = "text") -> Column:
    """The text cut at line breaks; a null or empty text is one empty line."""
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, rule: LineRule) -> DataFrame:
    """One row per line that can be a duplicate: document, line number, key, and whether it is the
    first line of the document with that key. ``body`` tells rows apart that share an id."""
    rows = docs.select(
        document_key().alias("doc"),
        F.xxhash64("text").alias("body"),
        F.transform(lines_of(), line_key).alias("keys"),
    )
    hashed = F.transform(
        "keys",
        lambda key, i: F.when(
            F.length(key) >= rule.min_chars,
            F.struct(
                F.xxhash64(key).alias("h1"),
                F.xxhash64(F.lit(1), key).alias("h2"),
                i.alias("line"),
            ),
        ),
    )
    rows = rows.select("doc", "body", F.sort_array(F.array_compact(hashed)).alias("found"))

    def marked(x: Column, i: Column) -> Column:
        before = F.get("found", i - 1)
        same = (before["h1"] == x["h1"]) & (before["h2"] == x["h2"])
        return F.struct(
            x["h1"].alias("h1"),
            x["h2"].alias("h2"),
            x["line"].alias("line"),
            (~F.coalesce(same, F.lit(False))).alias("first"),
        )

    return rows.select("doc", "body", F.inline(F.transform("found", marked)))


def batch_number(docs: DataFrame, batches: int) -> Column:
    """0 for the largest ids; ranges of ids with about equally many documents."""
    ranks = [n / batches for n in range(batches - 1, 0, -1)]
    if not ranks:
        return F.lit(0)
    cuts = docs.agg(F.percentile_approx(document_key(), ranks, 1_000).alias("cuts")).first().cuts
    number = F.lit(0)
    for cut in cuts or []:
        number += F.when(F.col("doc") <= cut, 1).otherwise(0)
    return number


def repeated_lines(docs: DataFrame, rule: LineRule) -> tuple[DataFrame, DataFrame]:
    """All long lines, and the keys that lie in ``min_docs`` documents or more with the largest
    document that holds each (``owner``)."""
    lines = long_lines(docs, rule).withColumn("batch", batch_number(docs, rule.batches))
    lines = stored(lines, ["batch"])
    runs, again = LineRuns(docs.sparkSession, rule.fan), None
    for n in range(rule.batches):
        own = lines.where((F.col("batch") == n) & F.col("first")).groupBy(*KEY)
        # Rows that share an id are one document, so ids are counted, not rows.
        keys = own.agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("owner"))
        keys = stored(runs.against(keys), ["fresh"])
        more = keys.where(~F.col("fresh")).select(*KEY, "docs")
        again = more if again is None else again.unionByName(more)
        runs.add(sorted_run(keys.where("fresh").select(*KEY, "docs", "owner")))
    more = again.groupBy(*KEY).agg(F.sum("docs").alias("more"))
    total = F.col("docs") + F.coalesce("more", F.lit(0))
    keys = runs.rows().join(more, KEY, "left").where(total >= rule.min_docs)
    return lines, keys.select(*KEY, "owner")


def dedup_lines(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """``docs`` with their text less the repeated lines, and ``n_lines`` before, ``n_dropped``.

    A key in ``min_docs`` documents or more loses all its lines except those in the largest
    doc_id that holds it. Rows that share a doc_id are one document there. A row without one is a
    document of its own, told apart by its text and smaller than all ids; if only such rows hold a
    key, a hash of the text decides which of them keeps it. A null or empty text is one empty line, which stays; the text returned is then
    empty. Other columns pass through; input columns named like the two counts are replaced.
    """
    lines, repeated = repeated_lines(docs, rule)
    repeated = stored(repeated)  # read plainly, so that Spark can split the tasks of a hot line
    drops = (
        lines.join(repeated, KEY)
        .where(F.col("doc") != F.col("owner"))
        .select(F.col("doc").alias("__doc"), F.col("body").alias("__body"), "line")
        .distinct()
        .groupBy("__doc", "__body")
        .agg(F.sort_array(F.collect_list("line")).alias("__drops"))
    )
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.withColumns({"__doc": document_key(), "__body": F.xxhash64("text")})
    rows = rows.join(drops, ["__doc", "__body"], "left").withColumn("__lines", lines_of())
    ends = F.concat(F.col("__drops"), F.array(F.size("__lines")))

    def between(end: Column, i: Column) -> Column:
        start = F.coalesce(F.get("__drops", i - 1) + 1, F.lit(0))
        return F.slice("__lines", start + 1, end - start)

    left = F.when(F.col("__drops").isNull(), F.col("__lines")).otherwise(
        F.flatten(F.transform(ends, between))
    )
    return rows.select(
        *names,
        F.array_join(left, "\n").alias("text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_digests(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    kept = dedup_lines(docs.select("doc_id", "text"), rule)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
