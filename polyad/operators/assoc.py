"""Association tensors: counts over the lattice of role subsets, and the weights made of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import LOWEST, SHIFT, softplus
from .vocab import checked_broadcast, indexed, marginals, normalised, vocabulary

METHODS = ("counting", "sii", "sc", "siiSoftPlus", "scSoftPlus", "siiShifted", "scShifted")


def subsets(n: int, least: int = 1) -> list[tuple[int, ...]]:
    return [s for r in range(least, n + 1) for s in combinations(range(n), r)]


def joint_counts(rows: DataFrame, vocab: DataFrame, roles: list[str], k: int) -> DataFrame:
    """(i0, i1, ..., cnt) with nulls for tokens outside the vocabulary: all later counts come from this."""
    keys = [f"i{j}" for j in range(len(roles))]
    return indexed(rows, vocab, roles, k).groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


def lattice(joint: DataFrame, n: int, least: int = 2, most: int | None = None) -> DataFrame:
    """Counts of every subset of ``least`` to ``most`` (all) roles: (subset, i0, ..., cnt).

    A row counts for a subset if the subset's tokens are known, whatever the others are. subset is the mask
    of grouped-away roles (grouping_id): the first role is the highest bit.
    """
    keys = [f"i{j}" for j in range(n)]
    sets = [[F.col(keys[j]) for j in s] for s in subsets(n, least) if len(s) <= (most or n)]
    grouped = joint.groupingSets(sets, *keys).agg(F.grouping_id(*keys).cast("int").alias("subset"), F.sum("cnt").alias("cnt"))
    bit = lambda j: 1 << (n - 1 - j)
    known = reduce(Column.__and__, [(F.col("subset").bitwiseAND(F.lit(bit(j))) != 0) | F.col(keys[j]).isNotNull() for j in range(n)])
    return grouped.filter(known)


def subset_id(subset: tuple[int, ...], n: int) -> int:
    return sum(1 << (n - 1 - j) for j in range(n) if j not in subset)


@dataclass
class Populated:
    """A populated tensor family: the vocabulary and, for each k, coordinates with all weights."""

    vocab: DataFrame
    cells: DataFrame
    roles: list[str]
    total: int
    top_ks: tuple[int, ...]
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Lets go of what is persisted."""
        for df in self.held:
            df.unpersist()

    def tensor(self, method: str, k: int | None = None) -> DataFrame:
        """(i0, ..., value) of one method and vocabulary size."""
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, not {method!r}")
        k = max(self.top_ks) if k is None else k
        return self.cells.filter(F.col("top_k") == k).select(*[f"i{j}" for j in range(len(self.roles))], F.col(method).alias("value"))


def populate(df: DataFrame, roles: list[str], top_ks: tuple[int, ...], shared: list[tuple[int, int]] | None = None, keep: bool = True, counts: DataFrame | None = None) -> Populated:
    """Counts and association weights of all tuples over the most frequent tokens of each role.

    p is relative to all rows, those with unknown tokens included. sii sums ln p over all subsets of the tuple,
    plus for even sizes and minus for odd ones; sc is ln of the joint p over the product of the single ones.
    Softplus and shift are taken over the cells of a top_k. Smaller vocabularies are prefixes of the largest,
    so one pass counts for all. The rows are read twice, for the vocabulary and for the joint counts; only
    these counts, of at most one more than the vocabulary in each role, are persisted (keep), until release().
    counts: the marginals of the rows, where the caller has a shorter way to them.
    """
    n, k = len(roles), max(top_ks)
    keys = [f"i{j}" for j in range(n)]
    rows, held = normalised(df, roles), []

    def kept(x: DataFrame) -> DataFrame:
        if keep:
            held.append(x.persist())
        return x

    vocab = kept(vocabulary(marginals(rows, roles) if counts is None else counts, roles, k, shared))
    joint = kept(joint_counts(rows, vocab, roles, k))
    total = joint.agg(F.sum("cnt")).first()[0] or 0
    log_p = lambda c: F.ln(F.col(c).cast("double") / F.lit(float(max(total, 1))))
    # the counts of single roles are the vocabulary's own; those of the whole tuple are there already
    full, whole = joint.dropna(subset=keys), log_p("cnt")
    own, sc = (whole if n % 2 == 0 else -whole), whole
    for j, r in enumerate(roles if n > 1 else []):
        single = vocab.filter(F.col("role") == r).select(F.col("idx").alias(keys[j]), F.col("cnt").alias(f"c{j}"))
        full = full.join(checked_broadcast(single, k, 1), keys[j])
        own, sc = own - log_p(f"c{j}"), sc - log_p(f"c{j}")
    cells = full.select(*keys, "cnt", own.alias("sii"), sc.alias("sc"))
    if middle := [s for s in subsets(n, 2) if len(s) < n]:
        # every cell asks once for each of its other subsets; one join and one sum answer all of them
        gone, at = F.lit(-1), [f"a{j}" for j in range(n)]
        asked = [F.struct(F.lit(subset_id(s, n)).alias("subset"), F.lit(1 if len(s) % 2 == 0 else -1).alias("sign"), *[(F.col(keys[j]) if j in s else gone).alias(at[j]) for j in range(n)]) for s in middle]
        counted = lattice(joint, n, 2, n - 1).select("subset", *[F.coalesce(F.col(c), gone).alias(a) for c, a in zip(keys, at)], F.col("cnt").alias("c"))
        long = cells.select(*keys, "cnt", "sii", "sc", F.explode(F.array(*asked)).alias("q")).select(*keys, "cnt", "sii", "sc", "q.*").join(counted, ["subset", *at])
        cells = long.groupBy(*keys).agg(F.max("cnt").alias("cnt"), (F.max("sii") + F.sum(F.col("sign") * log_p("c"))).alias("sii"), F.max("sc").alias("sc"))
    sc = F.coalesce("sc", F.lit(LOWEST)) if n > 1 else F.lit(0.0)
    cells = cells.select(*keys, F.col("cnt").cast("double").alias("counting"), F.coalesce("sii", F.lit(LOWEST)).alias("sii"), sc.alias("sc"))
    sized = cells.withColumn("top_k", F.explode(F.array(*map(F.lit, sorted(set(top_ks)))))).filter(F.greatest(*keys) < F.col("top_k") if n > 1 else F.col(keys[0]) < F.col("top_k"))
    sized = kept(sized)
    lows = sized.groupBy("top_k").agg(F.min("sii").alias("_sii"), F.min("sc").alias("_sc"))  # one row a top_k
    out = sized.join(F.broadcast(lows), "top_k")
    out = out.select("top_k", *keys, "counting", "sii", "sc", softplus(F.col("sii")).alias("siiSoftPlus"), softplus(F.col("sc")).alias("scSoftPlus"), (F.col("sii") - F.col("_sii") + SHIFT).alias("siiShifted"), (F.col("sc") - F.col("_sc") + SHIFT).alias("scShifted"))
    return Populated(vocab, out, list(roles), total, tuple(sorted(set(top_ks))), held)


def unrestricted_joints(rows: DataFrame, roles: list[str]) -> DataFrame:
    """(roles..., subset, cnt): counts of every subset of roles over all rows, whatever the vocabulary."""
    sets = [[F.col(roles[j]) for j in s] for s in subsets(len(roles))]
    return rows.groupingSets(sets, *roles).agg(F.grouping_id(*roles).cast("int").alias("subset"), F.count(F.lit(1)).alias("cnt"))


def with_tokens(cells: DataFrame, vocab: DataFrame, roles: list[str], k: int) -> DataFrame:
    """Cells with each index's token in a column of the role's name."""
    out = cells
    for j, r in enumerate(roles):
        v = vocab.filter(F.col("role") == r).select(F.col("idx").alias(f"i{j}"), F.col("token").alias(r))
        out = out.join(checked_broadcast(v, k, 1), f"i{j}")
    return out
