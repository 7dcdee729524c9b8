"""Terms of a text in Python, for operators that count within blocks of Arrow batches.

Counting inside a block costs a dictionary lookup per word; exploding every word into a Spark row first would sort and
shuffle several times the size of the texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.functions.text import DIGITS, LEAST_LETTERS, SEPARATORS, WHITE_SPACE
from rillstone.plans.cut import cut
from rillstone.plans.spread import hot_groups, split

PIECES = {ord(c): " " for c in SEPARATORS + WHITE_SPACE} | {ord(c): None for c in DIGITS}


def words_of(text: str | None) -> list[str]:
    """Terms with repeats, as `functions.text.all_terms` gives them. A null text has none."""
    if not text:
        return []
    return [w for w in text.translate(PIECES).lower().split(" ") if len(w) >= LEAST_LETTERS]


def sorted_runs(text_column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes one sorted run of each Arrow batch of records: (term, block, records, occurrences).

    The (term, record) pairs of the batch are sorted as numbers and scanned by run length. A row without a term holds the
    number of records of the block. `block` tells the runs apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            codes: dict[str, int] = defaultdict()
            codes.default_factory = codes.__len__
            pairs, lengths = [], []
            for text in batch.column(text_column).to_pylist():
                ids = [codes[w] for w in words_of(text)]
                pairs += ids
                lengths.append(len(ids))
            terms = list(codes)
            rank = np.empty(len(terms), np.int64)
            order = sorted(range(len(terms)), key=terms.__getitem__)
            rank[order] = np.arange(len(terms))
            key = (rank[np.array(pairs, np.int64)] << 32) | np.repeat(np.arange(len(lengths)), lengths)
            key.sort()
            term_of = key >> 32
            new_pair = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            occurrences = np.bincount(term_of, minlength=len(terms))
            records = np.bincount(term_of[new_pair], minlength=len(terms))
            at += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] + [terms[i] for i in order], pa.string()),
                    pa.array(np.full(len(terms) + 1, at)),
                    pa.array(np.r_[len(lengths), records].astype(np.int64)),
                    pa.array(np.r_[len(pairs), occurrences].astype(np.int64)),
                ],
                ["term", "block", "records", "occurrences"],
            )

    return run


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the neighbouring rows of a term in a sorted partition: (term, records, occurrences)."""
    open_term, open_sums = None, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = batch.column("term").to_pylist()
        starts = [0] + [i for i in range(1, len(terms)) if terms[i] != terms[i - 1]]
        sums = [np.add.reduceat(batch.column(c).to_numpy(), starts) for c in ("records", "occurrences")]
        out = [terms[i] for i in starts]
        if open_term is not None:
            if out[0] == open_term:
                for s, o in zip(sums, open_sums):
                    s[0] += o
            else:
                out = [open_term, *out]
                sums = [np.r_[o, s] for s, o in zip(sums, open_sums)]
        open_term, open_sums = out[-1], [int(s[-1]) for s in sums]
        if len(out) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(out[:-1], pa.string()), *[pa.array(s[:-1].astype(np.int64)) for s in sums]], ["term", "records", "occurrences"])
    if open_term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_term], pa.string()), *[pa.array([o], pa.int64()) for o in open_sums]], ["term", "records", "occurrences"])


SHARD_ROWS = 20_000
MOST_HOT = 1_000_000
TASK_BYTES = 64_000_000


def grouped_counts(rows: DataFrame, stopwords: list[str], by: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(kind, gid, term, n): content terms of each group of records, by 'records' or by 'occurrences'.

    `rows` has `record`, `text` and `kind` and `gid`, or, for records that belong to several groups, `groups`, an array of
    (kind, gid). Rows with a null group or record drop out; repeated records of a group count once, with the terms that
    come first in order. A text is split into terms once, where it is read, and only its content terms move on. Groups are
    counted where their terms meet; every group with more than `shard_rows` rows is counted in shards by record, each of
    about as many rows, and then added up, so no task holds more than a shard of a hot group. A group must also hold more
    than a `MOST_HOT`-th of all rows, which bounds the table of hot groups. The number of tasks follows the size of the terms.
    """
    if by not in ("records", "occurrences"):
        raise ValueError("by must be 'records' or 'occurrences'")
    groups = F.col("groups") if "groups" in rows.columns else F.array(F.struct(F.col("kind"), F.col("gid")))
    named = rows.select(groups.alias("groups"), F.col("record").cast("string").alias("record"), "text").where("record IS NOT NULL AND text IS NOT NULL")
    split_once = named.mapInArrow(_content(frozenset(stopwords), by), "groups array<struct<kind:string,gid:string>>, record string, terms string")
    found = cut(split_once.select(F.inline("groups"), "record", "terms").where("kind IS NOT NULL AND gid IS NOT NULL"), "terms")
    total, size = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("terms") + F.octet_length("gid") + F.octet_length("record"))).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // TASK_BYTES))
    sizes = found.groupBy("kind", "gid").agg(F.count(F.lit(1)).alias("rows"))
    hot = hot_groups(sizes, ["kind", "gid"], "rows", shard_rows, total, MOST_HOT)

    def counted(part: DataFrame) -> DataFrame:
        place = ["kind", "gid", "__part"]
        sent = part.repartition(tasks, *place).sortWithinPartitions(*place, "record", "terms")
        return sent.mapInArrow(_count_groups, "kind string, gid string, terms array<struct<term:string,n:bigint>>").select("kind", "gid", F.inline("terms"))

    if hot is None:
        return counted(found.withColumn("__part", F.lit(0)))
    cold = found.join(hot, ["kind", "gid"], "left_anti").withColumn("__part", F.lit(0))
    parts = split(found.join(hot, ["kind", "gid"], "left_semi"), ["kind", "gid"], hot, "record")
    return counted(cold).unionByName(counted(parts).groupBy("kind", "gid", "term").agg(F.sum("n").alias("n")))


def _content(stop: frozenset[str], by: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces each text by its content terms, joined by blanks; for 'records' each term once. Rows without any drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found.append(" ".join(sorted(set(words) - stop) if by == "records" else [w for w in words if w not in stop]) or None)
            every = pa.RecordBatch.from_arrays([batch.column("groups"), batch.column("record"), pa.array(found, pa.string())], ["groups", "record", "terms"])
            yield every.filter(every.column("terms").is_valid())

    return run


def _count_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the terms of each (kind, gid, part) of a sorted partition, each record once."""

    def batch_of(groups: list[tuple[str, str]], sizes: list[int], terms: list[str], ns: list[int]) -> pa.RecordBatch:
        each = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(ns, pa.int64())], ["term", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), each)
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), lists], ["kind", "gid", "terms"])

    key, last, counts = None, None, Counter()
    groups, sizes, terms, ns = [], [], [], []

    def close() -> None:
        groups.append(key[:2])
        sizes.append(len(counts))
        terms.extend(counts)
        ns.extend(counts.values())

    for batch in batches:
        for kind, gid, part, record, words in zip(*[batch.column(c).to_pylist() for c in ("kind", "gid", "__part", "record", "terms")]):
            if (kind, gid, part) != key:
                if counts:
                    close()
                    counts = Counter()
                    if len(terms) > 100_000:
                        yield batch_of(groups, sizes, terms, ns)
                        groups, sizes, terms, ns = [], [], [], []
                key, last = (kind, gid, part), None
            if record != last:
                last = record
                counts.update(words.split(" "))
    if counts:
        close()
    if groups:
        yield batch_of(groups, sizes, terms, ns)
