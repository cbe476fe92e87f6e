"""Set-based experiment plans: selections, interleavings, donors and orders in closed form."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vislens.operators.ordered import hash_chunk, rank_by, time_chunk
from vislens.operators.similarity import block_join


def round_robin(df: DataFrame, topic_index: str, n_topics: Column | int, variant: str, n_variants: int, order: str, key: str) -> DataFrame:
    """Slot of every row in a topic round-robin with alternating variants.

    The r-th row of (topic, variant) in hash order sits in round
    (r-1)*n_variants + variant; no slot table is needed.
    """
    r = rank_by(df, [topic_index, variant], hash_chunk(order), [F.col(order), F.col(key)], "__r")
    turn = (F.col("__r") - 1) * n_variants + F.col(variant)
    return r.withColumn("slot", turn * n_topics + F.col(topic_index)).drop("__r")


def interleave(df: DataFrame, keys: list[str], second: str, order: str, key: str) -> DataFrame:
    """Alternate two strata (`second` false first); the longer one's surplus follows."""
    r = rank_by(df, [*keys, second], hash_chunk(order), [F.col(order), F.col(key)], "__r")
    sizes = df.groupBy(*keys).agg(F.count(F.when(F.col(second), 1)).alias("__b"), F.count(F.when(~F.col(second), 1)).alias("__a"))
    r = r.join(sizes, keys)
    common = F.least("__a", "__b")
    pos = F.when(F.col("__r") <= common, 2 * F.col("__r") - 1 + F.col(second).cast("int")).otherwise(common + F.col("__r"))
    return r.withColumn("position", pos).drop("__r", "__a", "__b")


def ordered_injection(df: DataFrame, keys: list[str], role_order: Column, t: str, key: str, width: int) -> DataFrame:
    """Ordinal of every item: by role, then time; exact for units of any size."""
    d = df.withColumn("__role", role_order)
    chunk = F.col("__role") * F.lit(1 << 40) + time_chunk(t, width)
    return rank_by(d, keys, chunk, [F.col("__role"), F.col(t), F.col(key)], "ordinal").drop("__role")


def schedule(df: DataFrame, ordinal: str, qps: float, roles: tuple[str, ...], per_role: int) -> DataFrame:
    """Target time i/qps, role i mod n_roles and query ordinal (i div n_roles) mod per_role."""
    i = F.col(ordinal)
    n = len(roles)
    return df.withColumns(
        {
            "target_us": F.round(i * (1_000_000.0 / qps)).cast("bigint"),
            "role": F.element_at(F.array(*[F.lit(r) for r in roles]), (i % n + 1).cast("int")),
            "query_ordinal": F.floor(i / n) % per_role,
        }
    )


def smallest_pair_hash(owners: DataFrame, donors: DataFrame, domain: str, *, owner_group: str = "group", donor_group: str = "group", owner: str = "owner", donor: str = "donor") -> DataFrame:
    """(owner, donor): of the donors of its group the one whose hash with the owner is smallest; owners of a group without donors are left out.

    All pairs of a group are hashed, in blocks; only an owner's best of a block leaves it.
    """
    owner_type, donor_type = (df.schema[c].dataType.simpleString() for df, c in ((owners, owner), (donors, donor)))
    big = donors.select(F.col(donor).alias("d"), F.col(donor_group).cast("string").alias("g"))
    other = owners.select(F.col(owner).alias("o"), F.col(owner_group).cast("string").alias("g"))

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        names: dict = {}
        for d, g in zip(lt["d"].to_pylist(), lt["g"].to_pylist()):
            names.setdefault(g, []).append((f"|{d}".encode(), d))
        out: dict[str, list] = {"o": [], "h": [], "d": []}
        for o, g in zip(rt["o"].to_pylist(), rt["g"].to_pylist()):
            start = hashlib.sha256(f"{domain}|{o}".encode())
            best = None
            for tail, d in names.get(g, ()):
                digest = start.copy()
                digest.update(tail)
                found = (digest.hexdigest(), d)
                best = found if best is None or found < best else best
            if best:
                out["o"].append(o), out["h"].append(best[0]), out["d"].append(best[1])
        return pa.table({"o": pa.array(out["o"], rt.schema.field("o").type), "h": pa.array(out["h"], pa.string()), "d": pa.array(out["d"], lt.schema.field("d").type)})

    part = block_join(big, other, kernel, f"o {owner_type}, h string, d {donor_type}")
    return part.groupBy(F.col("o").alias(owner)).agg(F.min(F.struct("h", "d"))["d"].alias(donor))
