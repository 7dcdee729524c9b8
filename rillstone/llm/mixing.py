"""Mixing sources to target weights: token sizes, repeats, and balanced sampling by the cube method."""

from __future__ import annotations

import base64
import random
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.plans.cut import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 5_000
_ENCODINGS: dict[int, object] = {}


def token_counts(documents: DataFrame, *keep: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns `keep` and `tokens`, the size of `text` in tokens of a public byte-level BPE; a null text has 0.

    The vocabulary file is read once, on the driver, and sent to the executors; it has some 50,000 entries.
    """
    from public_tokenizers import PATTERN

    if {*keep} & {"text", "tokens"}:
        raise ValueError("text and tokens are names of the operator's own columns")
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast((f.read(), PATTERN))
    schema = documents.select(*keep).schema
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in schema)
    return documents.select(*keep, "text").mapInArrow(_counter(ranks, keep), f"{kinds}, tokens long")


def _counter(ranks, keep: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        lines, pattern = ranks.value
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(sizes, pa.int64())], [*keep, "tokens"])

    return run


def clean_source(column: str = "source"):
    """Trimmed, lower case; empty is null."""
    return F.nullif(F.lower(F.trim(F.col(column))), F.lit(""))


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, wanted, planned, rate, can_reach) for every source of `targets`.

    `sizes` has source and tokens for every document; documents without a source count in the total only. `targets` has
    source, target_share, max_repeats; rows that name one source in different spellings add up their shares and take the
    larger cap, a null share is 0, a null cap 1. `planned` is the total of all documents, `wanted` the share of it, `rate` how often each
    document of the source is taken on average: wanted / tokens, at most max_repeats. A source without documents can't reach a
    positive share.
    """
    goal = (
        targets.select(clean_source().alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("t"), F.coalesce("max_repeats", F.lit(1)).alias("m"))
        .where("source IS NOT NULL")
        .groupBy("source")
        .agg(F.sum("t").alias("target_share"), F.max("m").cast("long").alias("max_repeats"))
    )
    have = sizes.groupBy(clean_source().alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    total = have.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    full = goal.join(have, "source", "left").join(F.broadcast(total)).withColumns({"docs": F.coalesce("docs", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    wanted = F.col("target_share") * F.col("total")
    return full.withColumn("wanted", wanted).select(
        "source", "target_share", "max_repeats", "docs", "tokens", "wanted", F.col("total").alias("planned"),
        F.when(F.col("tokens") > 0, F.least(F.col("wanted") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)).alias("rate"),
        (F.col("tokens") * F.col("max_repeats") >= F.col("wanted")).alias("can_reach"),
    )


def flight(tokens: list[float], chance: list[float], rng: random.Random, constraints: int = 2) -> list[float]:
    """Moves inclusion chances through the null space of the constraints until at most `constraints` of them are open.

    The constraints keep the expected number of documents and (with 2) of tokens; every step settles at least one unit at 0
    or 1, and the expectation of every unit stays what it was.
    """
    p = list(chance)
    ahead = (i for i, x in enumerate(p) if 1e-9 < x < 1 - 1e-9)
    window: list[int] = []
    while True:
        while len(window) <= constraints and (i := next(ahead, None)) is not None:
            window.append(i)
        if len(window) <= constraints:
            break
        if constraints == 2:
            a, b, c = (tokens[i] for i in window)
            v = [c - b, a - c, b - a]
            if not any(v):
                v = [1.0, -1.0, 0.0]
        else:
            v = [1.0, -1.0]
        up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(window, v) if d)
        down = min(p[i] / d if d > 0 else -(1 - p[i]) / d for i, d in zip(window, v) if d)
        move = up if rng.random() * (up + down) < down else -down
        for i, d in zip(window, v):
            p[i] = min(1.0, max(0.0, p[i] + move * d))
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = float(round(p[i]))
        window = [i for i in window if 0 < p[i] < 1]
    return p


def land(tokens: list[float], chance: list[float], rng: random.Random) -> list[float]:
    """Settles the few units a flight left: first keeping the number of documents, then each by its chance."""
    p = flight(tokens, chance, rng, constraints=1)
    return [x if x in (0.0, 1.0) else float(rng.random() < x) for x in p]


def cube_sample(units: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, taken): a sample with the given chances that keeps each source's expected documents and tokens.

    `units` has doc_id, source, tokens and chance. The flight runs in blocks of about `block` units of a source; each block
    leaves at most two open, which go into the next round's blocks, until a source fits one block. There the landing settles
    the last two. Blocks of a large source run in parallel, and no task holds more than a block. Random numbers depend on seed
    and document only: a task that runs again gives the same result.
    """
    names = "doc_id long, source string, tokens long, chance double, last boolean"

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"])
        rng = random.Random(f"{seed} {pdf.source.iloc[0]} {pdf.doc_id.iloc[0]} {len(pdf)}")
        sizes, last = pdf.tokens.astype(float).tolist(), bool((pdf.blocks == 1).all())
        p = flight(sizes, pdf.chance.tolist(), rng)
        if last:
            p = land(sizes, p, rng)
        return pdf.assign(chance=p, last=last)[["doc_id", "source", "tokens", "chance", "last"]]

    settled, turn, left = [], 0, units.select("doc_id", "source", "tokens", "chance")
    while True:
        counts = left.groupBy("source").agg(F.count(F.lit(1)).alias("units")).withColumn("blocks", F.ceil(F.col("units") / block).cast("long"))
        hashed = left.join(counts, "source").withColumn("h", F.xxhash64("doc_id", F.lit(f"{seed}/{turn}")))
        flown = hashed.withColumn("block", F.pmod("h", "blocks")).groupBy("source", "block").applyInPandas(lambda _, pdf: fly(pdf), names)
        flown = cut(flown, f"flight{turn}")
        settled.append(flown.where("chance IN (0.0, 1.0)"))
        left = flown.where("chance > 0 AND chance < 1").select("doc_id", "source", "tokens", "chance")
        turn += 1
        if left.isEmpty():
            break
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    return every.select("doc_id", "source", "chance").withColumn("taken", F.col("chance").cast("int")).drop("chance")


def mix(sizes: DataFrame, plan: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document goes into the mix, documents left out excepted.

    Each document of a source is repeated floor(rate) times, and once more with the remaining chance, by balanced sampling.
    """
    rated = sizes.select("doc_id", clean_source().alias("source"), "tokens").join(plan.select("source", "rate", "max_repeats"), "source")
    rated = cut(rated.withColumn("whole", F.floor("rate")).withColumn("chance", F.col("rate") - F.col("whole")), "rated")
    extra = cube_sample(rated.where("chance > 0"), seed, block).select("doc_id", "taken")
    copies = F.least(F.col("whole") + F.coalesce("taken", F.lit(0)), F.col("max_repeats"))
    return rated.join(extra, "doc_id", "left").select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def mix_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, share_of_mix, documents, copies, tokens, can_reach, exhausted, falls_short) of a mix.

    `reached_share` is of the planned total, of which targets are shares; `share_of_mix` is of what the mix really holds, which
    is less where sources fall short. A source is exhausted if the mix has all its documents, each as often as it may be,
    and falls short if they hold fewer tokens than wanted.
    """
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed"))
    total = got.agg(F.sum("mixed").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda of: F.round(F.coalesce(F.try_divide("mixed", of), F.lit(0.0)), 6)
    # A document without tokens has rate 0 where its whole source has none; such a source is exhausted as it is.
    exhausted = (zero(F.col("copies")) >= F.col("docs") * F.col("max_repeats")) | (F.col("docs") == 0) | (zero(F.col("planned")) == 0) | (F.col("rate") == 0)
    return plan.withColumnRenamed("tokens", "held").join(got, "source", "left").join(F.broadcast(total)).select(
        "source", F.round("target_share", 6).alias("target_share"), share(F.col("planned")).alias("reached_share"), share(F.col("total")).alias("share_of_mix"),
        zero("documents").alias("documents"), zero("copies").alias("copies"), zero(F.col("mixed")).alias("tokens"), "can_reach",
        exhausted.alias("exhausted"), (zero(F.col("mixed")) < F.col("wanted")).alias("falls_short"),
    )
