"""A mix of sources with target shares of all tokens: entropy balancing by distributed Newton iterations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.session import checkpoint

#: Bins of each of the two passes that settle the rounding.
BINS = 1024


def token_targets(available: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """The tokens that each source is to have.

    Without ``total``, the mix is the largest in which every source that has any tokens reaches its share (shares of
    sources without tokens are spread over the others in proportion). With it, a source that can't reach its share gives
    all it may, and the others fill up the total in proportion to their shares, as far as they may.
    """
    most = {s: available.get(s, 0) * max(0, repeats[s]) for s in shares}
    open_, out = {s for s in shares if most[s] > 0 and shares[s] > 0}, dict.fromkeys(shares, 0.0)
    if not open_:
        return out
    if total is None:
        whole = sum(shares[s] for s in open_)
        total = min(most[s] * whole / shares[s] for s in open_)
    left = float(total)
    while open_:
        whole = sum(shares[s] for s in open_)
        full = {s for s in open_ if left * shares[s] / whole >= most[s] * (1 - 1e-12)}
        if not full:
            return out | {s: left * shares[s] / whole for s in open_}
        for s in full:
            out[s] = float(most[s])
            left -= most[s]
        open_ -= full
    return out


def _lookup(values: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def document_rates(counted: DataFrame, targets: dict[str, float], repeats: dict[str, int], tolerance: float = 1e-9, most_steps: int = 60) -> tuple[dict[str, tuple[float, float]], DataFrame]:
    """The dual's solution and (doc_id, source, n_tokens, rate).

    Among all rates 0 <= w_i <= max_repeats whose tokens sum to the target of each source, those nearest to 1 in relative
    entropy are w_i = min(max_repeats, exp(a_s x_i)), x_i being the tokens of the document relative to its source's mean.
    a solves a convex problem of one dimension a source; each Newton step is one aggregation over the counts of documents
    by source and length, of which one row a source comes to the driver. Steps are kept within the bracket found so far.
    """
    sized = checkpoint(counted.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    means = {r["source"]: (r["t"] / r["n"], r["t"]) for r in sized.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum("n").alias("n")).collect()}
    tilt = {s: (0.0, means[s][0]) for s in targets if s in means}
    full = {s for s in tilt if targets[s] >= means[s][1] * repeats[s] * (1 - 1e-12)}
    low, high = dict.fromkeys(tilt, -700.0), dict.fromkeys(tilt, 700.0)
    todo = {s for s in tilt if s not in full and targets[s] > 0}
    x = F.col("n_tokens") / _lookup({s: m for s, (_, m) in tilt.items()}, F.col("source")) if tilt else F.lit(0.0)

    def rate(a: dict[str, float]) -> Column:
        cap = _lookup({s: float(repeats[s]) for s in tilt}, F.col("source"))
        return F.least(cap, F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), _lookup(a, F.col("source")) * x))))

    a = dict.fromkeys(tilt, 0.0)
    for _ in range(most_steps):
        if not todo:
            break
        w = rate(a)
        cap = _lookup({s: float(repeats[s]) for s in tilt}, F.col("source"))
        sums = sized.where(F.col("source").isin(*todo)).groupBy("source").agg(F.sum(F.col("n") * w * F.col("n_tokens")).alias("g"), F.sum(F.when(w < cap, F.col("n") * w * F.col("n_tokens") * x).otherwise(0.0)).alias("h")).collect()
        for r in sums:
            s, gap = r["source"], r["g"] - targets[r["source"]]
            if abs(gap) <= tolerance * max(1.0, targets[s]):
                todo.discard(s)
                continue
            if gap > 0:
                high[s] = a[s]
            else:
                low[s] = a[s]
            step = a[s] - gap / r["h"] if r["h"] > 0 else math.nan
            a[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    fixed = {s: float(repeats[s]) if s in full else 0.0 for s in targets if s in full or targets[s] <= 0}
    solved = _lookup(fixed, F.col("source")) if fixed else F.lit(None).cast("double")
    known = F.when(F.col("n_tokens") <= 0, F.lit(0.0)).otherwise(F.coalesce(solved, rate(a) if tilt else F.lit(0.0), F.lit(0.0)))
    return {s: (a[s], tilt[s][1]) for s in tilt}, counted.withColumn("rate", known)


def round_to_copies(rated: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The input with ``copies``: each rate rounded down or up so that the tokens of each source come nearest to its target.

    A document is rounded up if its place z = u / fraction is below the threshold of its source, u being uniform by a hash of
    the id. The threshold (about 1) is found by two passes over sums in 1,024 bins; the documents of the one bin of a
    1,048,576th that the target falls in are all rounded up or all down, whichever comes nearer. So a source misses its
    target by at most half of the tokens of the documents in one such bin, usually of one document, if enough documents have a fraction.
    """
    u = (F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    base = F.floor(F.col("rate") + F.lit(1e-12))
    part = F.col("rate") - base
    z = F.when(part > 1e-12, u / part)
    rows = rated.withColumns({"base": base, "z": z})
    whole = {r["source"]: r["t"] or 0 for r in rows.groupBy("source").agg(F.sum(F.col("base") * F.col("n_tokens")).alias("t")).collect()}
    width, start, gone = {s: 2.0 / BINS for s in targets}, dict.fromkeys(targets, 0.0), {s: float(whole.get(s, 0)) for s in targets}
    for step in range(2):
        first, size = _lookup(start, F.col("source")), _lookup(width, F.col("source"))
        bin_ = F.floor((F.col("z") - first) / size)
        sums: dict[str, dict[int, int]] = {}
        for r in rows.where(F.col("z").isNotNull()).withColumn("b", bin_).where(F.col("b").between(0, BINS - 1)).groupBy("source", "b").agg(F.sum("n_tokens").alias("t")).collect():
            sums.setdefault(r["source"], {})[r["b"]] = r["t"]
        for s, by in sums.items():
            k = 0
            while k < BINS and gone[s] + by.get(k, 0) <= targets[s]:
                gone[s] += by.get(k, 0)
                k += 1
            # the bin that goes beyond the target is taken if that comes nearer
            if step and k < BINS and gone[s] + by.get(k, 0) - targets[s] < targets[s] - gone[s]:
                k += 1
            start[s] += k * width[s]
            width[s] /= BINS
    up = F.coalesce(F.col("z") < _lookup(start, F.col("source")), F.lit(False)) if targets else F.lit(False)
    return rows.withColumn("copies", (F.col("base") + up.cast("long")).cast("long")).drop("base", "z")


def mix_sources(counted: DataFrame, mix_targets: DataFrame, total: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies, target_tokens) of every document whose source is in ``mix_targets``.

    counted: doc_id, source, n_tokens. mix_targets: source, target_share, max_repeats, a table of the size of a
    configuration; it is read to the driver. A null share or cap counts as 0, of a repeated source the first row by share
    holds. Documents without tokens and sources without a target have no copies. See token_targets, document_rates, round_to_copies.
    """
    shares, repeats = {}, {}
    for r in mix_targets.where("source is not null").orderBy("source", "target_share", "max_repeats").collect():
        shares.setdefault(r["source"], float(r["target_share"] or 0))
        repeats.setdefault(r["source"], int(r["max_repeats"] or 0))
    kept = checkpoint(counted.where(F.col("source").isin(*shares)) if shares else counted.where("false"))
    available = {r["source"]: int(r["t"] or 0) for r in kept.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    targets = token_targets(available, shares, repeats, total)
    _, rated = document_rates(kept, targets, repeats)
    goal = _lookup(targets, F.col("source")) if targets else F.lit(0.0)
    return round_to_copies(rated, targets).withColumn("target_tokens", goal)


def mix_report(mix: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """One row a source of ``mix_targets``: its target and actual share of the mix, tokens, documents used and repeats.

    target_tokens is what the source was to have (null if it has no document), miss_tokens what it has beyond that, and
    largest_tokens the size of its largest document.
    """
    by = mix.groupBy("source").agg(
        F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mix_tokens"), F.count_if(F.col("copies") > 0).alias("used_docs"),
        F.max("copies").alias("most_repeats"), F.max("target_tokens").alias("target_tokens"), F.max("n_tokens").alias("largest_tokens"),
    )
    total = by.agg(F.sum("mix_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = mix_targets.join(by, "source", "left").join(F.broadcast(total))  # the total is one row
    share = F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share")
    return rows.select(
        "source", "target_share", "max_repeats", share, zero("available_tokens"), zero("mix_tokens"), zero("used_docs"), zero("most_repeats"),
        F.coalesce(F.col("mix_tokens") / F.col("available_tokens"), F.lit(0.0)).alias("mean_repeats"), "target_tokens", (F.col("mix_tokens") - F.col("target_tokens")).alias("miss_tokens"), zero("largest_tokens"),
    )
