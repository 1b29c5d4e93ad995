"""A small arithmetic hash, the same in Spark and in plain SQL.

Random choices must not depend on partitioning, task retries or the engine, so
they come from this hash of the row's own keys instead of ``rand()``. Affine
maps over two different primes alternate; every product stays below 2**63.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

P1, P2 = 2147483647, 2147483629
A1, C1 = 1000000007, 12345
A2, C2 = 715225739, 67891
LAST = 1073741789


def mixed(keys: list[Column], seed: int) -> Column:
    """Hash of non-negative integer keys to 0 <= h < P2."""
    h = F.lit(seed % P1).cast("long")
    for key in keys:
        h = ((h + key.cast("long") % P1) * A1 + C1) % P1
        h = (h * A2 + C2) % P2
    return (h * LAST % P1 * A2 + C1) % P2


def absorb_sql(state: str, key: str) -> str:
    """The hash's state after one more key."""
    state = f"((({state} + CAST({key} AS BIGINT) % {P1}) * {A1} + {C1}) % {P1})"
    return f"(({state} * {A2} + {C2}) % {P2})"


def finish_sql(state: str) -> str:
    return f"(({state} * {LAST} % {P1} * {A2} + {C1}) % {P2})"


def start_sql(seed: int) -> str:
    return f"CAST({seed % P1} AS BIGINT)"


def mixed_sql(keys: list[str], seed: int) -> str:
    """The same expression as DuckDB text."""
    h = start_sql(seed)
    for key in keys:
        h = absorb_sql(h, key)
    return finish_sql(h)


def uniform(keys: list[Column], seed: int) -> Column:
    """Hash as a double in [0, 1)."""
    return mixed(keys, seed) / F.lit(float(P2))


def uniform_sql(keys: list[str], seed: int) -> str:
    return f"(CAST({mixed_sql(keys, seed)} AS DOUBLE) / {float(P2)!r})"
