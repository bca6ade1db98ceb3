"""Seeds that depend on identifiers, never on scheduling order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED_MODULUS = 2147483647


def stable_seed(global_seed: int | Column, ligand_id: Column) -> Column:
    """First 32 bits of ``sha256('seed:id')`` reduced to a signed 32-bit range."""
    seed = F.lit(global_seed) if isinstance(global_seed, int) else global_seed
    digest = F.sha2(F.concat(seed.cast("string"), F.lit(":"), ligand_id), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % SEED_MODULUS


def conformer_seed(global_seed: int | Column, ligand_id: Column, conformer: Column) -> Column:
    return stable_seed(
        global_seed, F.concat(ligand_id, F.lit("#conf"), conformer.cast("string"))
    )


def spread_key(seed: int, ligand_id: Column) -> Column:
    """Sort key of a deterministic sample spread over the whole id range."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), ligand_id), 256)


def uniform(seed: int, key: Column, draw: str) -> Column:
    """Uniform double in (0, 1) from a seed, a row key and a draw name."""
    bits = F.pmod(F.xxhash64(F.lit(seed), F.lit(draw), key), F.lit(1 << 52))
    return (bits.cast("double") + 0.5) / float(1 << 52)
