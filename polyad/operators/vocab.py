"""Vocabularies: marginal counts, top-k tokens, roles that share one vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import MISSING

#: Vocabulary rows that may be broadcast: as many as top_k times the roles, never more than this.
MOST_BROADCAST = 2_000_000


def normalised(df: DataFrame, roles: list[str]) -> DataFrame:
    """Only the role columns; null and empty become the missing mark."""
    return df.select(*[F.coalesce(F.nullif(F.col(f"`{r}`").cast("string"), F.lit("")), F.lit(MISSING)).alias(r) for r in roles])


def marginals(rows: DataFrame, roles: list[str]) -> DataFrame:
    """(role, token, cnt) over all rows: one scan, partial counts before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("token")) for r in roles])).alias("x")
    return rows.select(pairs).groupBy("x.role", "x.token").agg(F.count(F.lit(1)).alias("cnt"))


def ngram_marginals(df: DataFrame, roles: list[str], tokens: str = "tokens") -> DataFrame:
    """The marginals of the n-grams of token rows, n as many as roles: one row a token is counted, not n for each n-gram."""
    n, size, at = len(roles), F.col("_size"), F.col("_at")
    # outer: for a plain column Spark would first ask whether it is empty, and make the tokens again for that
    words = df.select(F.size(tokens).alias("_size"), F.posexplode_outer(tokens).alias("_at", "token"))
    inside = [F.count(F.when((at >= j) & (at - j <= size - n), 1)).alias(f"_{j}") for j in range(n)]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), "token", F.col(f"_{j}").alias("cnt")) for j, r in enumerate(roles)]))
    return words.groupBy("token").agg(*inside).select(each.alias("x")).select("x.*").filter("cnt > 0")


def groups(n: int, shared: list[tuple[int, int]] | None = None) -> list[list[int]]:
    """Connected components of linked modes, each sorted, by smallest member; single modes too."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in shared or []:
        if not (0 <= a < n and 0 <= b < n) or a == b:
            raise ValueError(f"modes {a} and {b} can't be linked among {n}")
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    out: dict[int, list[int]] = {}
    for i in range(n):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def shared_suffix(links: list[list[int]]) -> str:
    """_shared12_shared34 for groups of more than one mode."""
    return "".join("_shared" + "".join(map(str, g)) for g in links if len(g) > 1)


def _ranked(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """idx from 0 for each role; row_number with a limit is cut within partitions before the shuffle."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy("role").orderBy(*order))).filter(F.col("idx") <= k).withColumn("idx", F.col("idx") - 1)


def vocabulary(counts: DataFrame, roles: list[str], k: int, shared: list[tuple[int, int]] | None = None) -> DataFrame:
    """(role, idx, token, cnt): the k most frequent tokens of each role; ties by token.

    Linked roles get one list: tokens by the harmonic mean of their counts (0 where a role lacks them),
    then by their sum, then by token, all descending.
    """
    linked = [g for g in groups(len(roles), shared) if len(g) > 1]
    alone = [r for i, r in enumerate(roles) if not any(i in g for g in linked)]
    parts = []
    if alone:
        parts.append(_ranked(counts.filter(F.col("role").isin(alone)), k, [F.desc("cnt"), F.asc("token")]).select("role", "idx", "token", "cnt"))
    for g in linked:
        names = [roles[i] for i in g]
        mean = F.when(F.count(F.lit(1)) == len(names), len(names) / F.sum(1 / (F.col("cnt") + F.lit(1e-12)))).otherwise(F.lit(0.0))
        scored = counts.filter(F.col("role").isin(names)).groupBy("token").agg(mean.alias("hm"), F.sum("cnt").alias("coverage"))
        best = _ranked(scored.withColumn("role", F.lit(names[0])), k, [F.desc("hm"), F.desc("coverage"), F.desc("token")]).drop("role")
        each = best.select(F.explode(F.array(*map(F.lit, names))).alias("role"), "idx", "token")
        parts.append(each.join(counts, ["role", "token"], "left").select("role", "idx", "token", F.coalesce("cnt", F.lit(0)).alias("cnt")))
    return reduce(DataFrame.unionByName, parts)


def checked_broadcast(vocab: DataFrame, k: int, roles: int) -> DataFrame:
    """A broadcast hint only for a vocabulary whose size is bounded by its parameters."""
    return F.broadcast(vocab) if k * roles <= MOST_BROADCAST else vocab


def indexed(rows: DataFrame, vocab: DataFrame, roles: list[str], k: int) -> DataFrame:
    """Columns i0, i1, ... with each role's index; null where the token isn't in the vocabulary."""
    out = rows
    for j, r in enumerate(roles):
        v = vocab.filter(F.col("role") == r).select(F.col("token").alias(r), F.col("idx").alias(f"i{j}"))
        out = out.join(checked_broadcast(v, k, 1), r, "left")
    return out.select(*[f"i{j}" for j in range(len(roles))])


def in_vocabulary(rows: DataFrame, vocab: DataFrame, roles: list[str], k: int) -> DataFrame:
    """The rows with a boolean known_<role> for each role, and known for all."""
    out = rows
    for r in roles:
        v = vocab.filter(F.col("role") == r).select(F.col("token").alias(r), F.lit(True).alias(f"known_{r}"))
        out = out.join(checked_broadcast(v, k, 1), r, "left").withColumn(f"known_{r}", F.coalesce(f"known_{r}", F.lit(False)))
    return out.withColumn("known", reduce(Column.__and__, [F.col(f"known_{r}") for r in roles]))


def replace_unknown(rows: DataFrame, vocab: DataFrame, roles: list[str], k: int) -> DataFrame:
    """Tokens outside the vocabulary become the missing mark."""
    flagged = in_vocabulary(rows, vocab, roles, k)
    return flagged.select(*[F.when(F.col(f"known_{r}"), F.col(r)).otherwise(F.lit(MISSING)).alias(r) if r in roles else F.col(r) for r in rows.columns])
