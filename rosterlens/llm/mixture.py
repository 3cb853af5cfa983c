"""Mixing sources to target shares of tokens by iterative proportional fitting and calibrated sampling.

Token totals of the cells (source, language, topic) are raked until their sources have the wanted shares and languages and
topics keep theirs. The quotient of a cell's raked and available tokens is the number of times its records are wanted: the
whole part is taken, the fraction is a probability. A draw by hash that does not depend on partitions decides; its threshold
is calibrated by source from a histogram of fixed size, so that actual shares meet the targets within one record or so.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

TOKENIZER = os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern by which the vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BINS = 4096
#: Rounds of raking at most; it ends when nothing moves.
ROUNDS = 500

_encodings: dict[str, object] = {}


def _encoding(path: str):
    """The tokenizer, built once by each worker from the vocabulary file, which every machine has."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of the whole text; a null or empty text has none."""
    src = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*[src.schema[c] for c in keep], T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def rake(cells: pd.DataFrame, targets: dict[str, float], caps: dict[str, int], total: float | None = None) -> tuple[np.ndarray, float]:
    """(expected repeats of each cell, total tokens) for cells with columns source, lang, topic, tokens.

    Without ``total`` it is the largest at which every source that has tokens can still reach its share within its cap.
    Shares of sources without tokens are spread over the others in proportion.
    """
    have = cells.groupby("source")["tokens"].sum()
    share = pd.Series({s: t for s, t in targets.items() if t > 0 and have.get(s, 0) > 0}, dtype=float)
    if share.empty:
        return np.zeros(len(cells)), 0.0
    share /= share.sum()
    most = min(have[s] * caps[s] / w for s, w in share.items())
    total = most if total is None else total
    tokens = cells["tokens"].to_numpy(float)
    use = cells["source"].isin(share.index).to_numpy() & (tokens > 0)
    cap = np.array([caps.get(s, 0) for s in cells["source"]], float) * tokens
    x = np.where(use, tokens, 0.0)
    margins = []
    for c in ("lang", "topic"):
        code = pd.factorize(cells[c], use_na_sentinel=False)[0]
        held = np.bincount(code, x)
        margins.append((code, held / held.sum() * total))
    source = pd.Categorical(cells["source"], categories=list(share.index)).codes.astype(int)
    wanted = np.append(share.to_numpy() * total, 0.0)
    source = np.where(source < 0, len(share), source)

    def fit(x: np.ndarray, code: np.ndarray, goal: np.ndarray) -> np.ndarray:
        now = np.bincount(code, x, len(goal))
        return x * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code]

    for _ in range(ROUNDS):
        before = x
        for code, goal in margins:
            x = np.minimum(fit(x, code, goal), cap)
        for _ in range(20):  # the sources' shares come last and are met by the cells that have room
            now = np.bincount(source, x, len(wanted))
            x = np.minimum(fit(x, source, wanted), cap)
            if np.allclose(now, wanted, rtol=1e-9):
                break
        if np.allclose(before, x, rtol=1e-7, atol=1e-6):
            break
    return np.divide(x, tokens, out=np.zeros_like(x), where=tokens > 0), total


def mix(sized: DataFrame, key: str, targets: DataFrame, total: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample, shares) of records with columns ``source``, ``lang``, ``topic`` and ``tokens`` (see count_tokens).

    ``targets``: source, target_share, max_repeats. ``sample``: key, ``source``, ``tokens``, ``repeats`` of every record taken.
    ``shares``: for every source of targets ``target_share``, ``max_repeats``, ``documents`` and ``tokens`` taken (with
    repeats) and ``actual_share``; the share is null if nothing is taken.

    A record given twice counts once; records of a null source, of one without a target or without tokens are never taken;
    a null language or topic is a class of its own. The draw depends on key and seed alone.
    """
    wanted = targets.select("source", "target_share", "max_repeats").collect()  # a handful of sources
    goal = {r.source: float(r.target_share or 0) for r in wanted if r.source is not None}
    caps = {r.source: int(r.max_repeats if r.max_repeats is not None else 1) for r in wanted if r.source is not None}
    sized = materialise(sized.filter(F.col("source").isin(list(goal))).groupBy(key).agg(*[F.min(c).alias(c) for c in ("source", "lang", "topic", "tokens")]), "sized")
    cells = sized.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).toPandas()  # sources x languages x topics
    repeats, total = rake(cells, goal, caps, total)

    spark = sized.sparkSession
    plan = cells[["source", "lang", "topic"]].assign(whole=np.floor(repeats + 1e-9).astype(int), part=np.maximum(repeats - np.floor(repeats + 1e-9), 0.0))
    told = spark.createDataFrame(plan, "source string, lang string, topic string, whole int, part double")
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}"))
    j = sized.join(F.broadcast(told.select(*[F.col(c).alias(f"_{c}") for c in ("source", "lang", "topic")], "whole", "part")), same("source") & same("lang") & same("topic"))
    # z: by what factor the probability must grow for the record to be drawn once more
    j = j.withColumn("z", F.when(F.col("part") > 1e-9, u / F.col("part"))).withColumn("bin", F.least(F.floor(F.col("z") * (BINS // 4)), F.lit(BINS - 1)).cast("int"))
    hist = j.groupBy("source", "bin").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("whole") * F.col("tokens")).alias("base")).toPandas()
    cut = {}
    for s, h in hist.groupby("source"):
        need = float((repeats * cells["tokens"])[cells["source"] == s].sum()) - h["base"].sum()
        bins = np.bincount(h["bin"].dropna().astype(int), h.loc[h["bin"].notna(), "tokens"], BINS)
        sums = np.concatenate([[0.0], np.cumsum(bins[: BINS - 1])])
        cut[s] = int(np.abs(sums - need).argmin())
    cuts = spark.createDataFrame([(s, c) for s, c in cut.items()] or [("", 0)], "source string, cut int")
    drawn = j.join(F.broadcast(cuts), "source").withColumn("repeats", F.col("whole") + F.when(F.col("bin") < F.col("cut"), 1).otherwise(0))
    sample = drawn.filter("repeats > 0").select(key, "source", "tokens", "repeats")
    taken = sample.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.sum("repeats").cast("bigint").alias("documents"))
    shares = targets.select("source", "target_share", "max_repeats").join(F.broadcast(taken), "source", "left").na.fill(0, ["tokens", "documents"])
    every = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # a row for each wanted source
    shares = shares.withColumn("actual_share", F.col("tokens") / F.nullif(every, F.lit(0)))
    return sample, shares
