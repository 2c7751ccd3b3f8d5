"""Additively homomorphic sums with Paillier ciphertexts as BINARY columns. The private key never leaves the driver."""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import gcd

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS = 1024  # fixed value
SLOT_BITS = 64


@dataclass(frozen=True)
class PublicKey:
    n: int

    @property
    def square(self) -> int:
        return self.n * self.n

    @property
    def width(self) -> int:
        return (self.square.bit_length() + 7) // 8

    def encrypt(self, value: int) -> int:
        while gcd(r := secrets.randbelow(self.n - 1) + 1, self.n) != 1:
            pass
        return (1 + self.n * (value % self.n)) % self.square * pow(r, self.n, self.square) % self.square


@dataclass(frozen=True)
class PrivateKey:
    public: PublicKey
    p: int
    q: int

    def decrypt(self, c: int) -> int:
        """Signed value by the two prime powers."""
        n, parts = self.public.n, []
        for p in (self.p, self.q):
            low = lambda x, p=p: (x - 1) // p
            h = pow(low(pow(1 + n, p - 1, p * p)), -1, p)
            parts.append(low(pow(c, p - 1, p * p)) * h % p)
        m = parts[0] + self.p * ((parts[1] - parts[0]) * pow(self.p, -1, self.q) % self.q)
        return m - n if m > n // 2 else m


def _is_prime(n: int) -> bool:
    if n % 2 == 0 or any(n % p == 0 for p in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31)):
        return n in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31)
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for _ in range(32):
        x = pow(secrets.randbelow(n - 3) + 2, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def generate_keys(bits: int = 2048) -> PrivateKey:
    if bits < LEAST_BITS:
        raise ValueError(f"at least {LEAST_BITS} bits")

    def prime() -> int:
        while not _is_prime(p := secrets.randbits(bits // 2) | (3 << bits // 2 - 2) | 1):
            pass
        return p

    p = prime()
    while (q := prime()) == p:
        pass
    return PrivateKey(PublicKey(p * q), p, q)


def _ddl(df: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"{c} {kinds[c]}, " for c in keys) + "coord int, ct binary"


def encrypted(vectors: DataFrame, key: PublicKey, *keys: str) -> DataFrame:
    """(keys..., coord, ct) of every (keys..., coord, value); clients' coordinates are encrypted in parallel with the public
    key alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[[*keys, "coord"]].assign(ct=[key.encrypt(int(v)).to_bytes(key.width, "big") for v in rows["value"]])

    return vectors.select(*keys, F.col("coord").cast("int").alias("coord"), "value").mapInPandas(run, _ddl(vectors, keys))


def slots_of(key: PublicKey) -> int:
    """Coordinates that fit one plaintext."""
    return (key.n.bit_length() - 2) // SLOT_BITS


def encrypted_packed(vectors: DataFrame, key: PublicKey, *keys: str) -> DataFrame:
    """(keys..., coord, ct) of (keys..., site_id, coord, value) with slots_of(key) coordinates of a client in a plaintext, so
    a sum costs that much less; coord is the number of the pack. Sums must stay below 2 ** (SLOT_BITS - 1) in size."""
    slots = slots_of(key)
    pack, slot = F.floor(F.col("coord") / slots).cast("int"), (F.col("coord") % slots).cast("int")
    packs = vectors.groupBy(*keys, "site_id", pack.alias("coord")).agg(F.collect_list(F.struct(slot.alias("slot"), F.col("value").cast("bigint").alias("value"))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            plain = [sum(int(p["value"]) << SLOT_BITS * int(p["slot"]) for p in parts) for parts in rows["parts"]]
            yield rows[[*keys, "coord"]].assign(ct=[key.encrypt(m).to_bytes(key.width, "big") for m in plain])

    # encryption is all computing: spread it over all cores, however few bytes there are
    spread = packs.drop("site_id").repartition(vectors.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, _ddl(packs, keys))


def unpacked(values: list[tuple], coordinates: int, key: PublicKey) -> list[tuple]:
    """(keys..., coord, value) of decrypted packs (keys..., coord, value)."""
    out = []
    for *own, pack, m in values:
        for slot in range(min(slots_of(key), coordinates - pack * slots_of(key))):
            value = (m + (1 << SLOT_BITS - 1)) % (1 << SLOT_BITS) - (1 << SLOT_BITS - 1)
            out.append((*own, pack * slots_of(key) + slot, value))
            m = (m - value) >> SLOT_BITS
    return out


def encrypted_sums(cipher: DataFrame, key: PublicKey, *keys: str) -> DataFrame:
    """(keys..., coord, ct): products modulo n squared, combined in each partition first, so one row a coordinate and
    partition is shuffled."""
    own = [*keys, "coord"]

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, int] = {}
        for rows in batches:
            for *coord, ct in rows[[*own, "ct"]].itertuples(index=False):
                held[tuple(coord)] = held.get(tuple(coord), 1) * int.from_bytes(ct, "big") % key.square
        yield pd.DataFrame([(*c, v.to_bytes(key.width, "big")) for c, v in held.items()], columns=[*own, "ct"])

    partial = cipher.mapInPandas(combine, _ddl(cipher, keys))
    return partial.repartition(*own).mapInPandas(combine, _ddl(cipher, keys))


def add_encrypted_noise(sums: DataFrame, noise: DataFrame, key: PublicKey, *keys: str) -> DataFrame:
    """Noise rows (keys..., coord, value) are encrypted and multiplied in."""
    return encrypted_sums(sums.unionByName(encrypted(noise, key, *keys)), key, *keys)


def decrypted(sums: DataFrame, key: PrivateKey, *keys: str) -> list:
    """Values in coordinate order on the driver, one row a candidate coordinate; with keys (keys..., coord, value)."""
    rows = sums.orderBy(*keys, "coord").collect()
    return [(*(r[k] for k in keys), r["coord"], v) if keys else v for r, v in ((r, key.decrypt(int.from_bytes(r["ct"], "big"))) for r in rows)]


def message_bytes(cells: DataFrame, key_bits: int) -> DataFrame:
    """(clients, k, upload_bytes, aggregate_bytes) of benchmark cells (clients, k)."""
    one = 2 * key_bits // 8
    return cells.select("clients", "k", (F.col("clients") * F.col("k") * one).alias("upload_bytes"), (F.col("k") * one).alias("aggregate_bytes"))


def product(values: list[int], key: PublicKey) -> int:
    return reduce(lambda a, b: a * b % key.square, values, 1)


def benchmark_cell(spark, clients: int, k: int, batch: int, key: PrivateKey, seed: int = 0) -> dict[str, float]:
    """One measured round: encrypt, sum, add noise, decrypt, choose; the result must equal the plain one."""
    import time

    import numpy as np

    from veilmark.operators.privacy import compatible_top, two_sided_geometric

    rng = np.random.default_rng(seed)
    rows = [(c, int(v)) for _ in range(clients) for c, v in enumerate(rng.integers(0, 100, k))]
    noise = two_sided_geometric(1.0, 10, k, rng)
    pairs = [(f"a{c}", f"b{c}") for c in range(k)]
    vectors = spark.createDataFrame(rows, "coord int, value bigint").repartition(max(1, clients))
    at = [time.perf_counter()]

    def lap(df: DataFrame) -> DataFrame:
        from veilmark.session import checkpointed

        df = checkpointed(df)
        at.append(time.perf_counter())
        return df

    cipher = lap(encrypted(vectors, key.public))
    sums = lap(encrypted_sums(cipher, key.public))
    sums = lap(add_encrypted_noise(sums, spark.createDataFrame(list(enumerate(noise)), "coord int, value bigint"), key.public))
    values = decrypted(sums, key)
    at.append(time.perf_counter())
    chosen = compatible_top(values, pairs, batch)
    at.append(time.perf_counter())
    plain = [sum(v for c, v in rows if c == coord) + noise[coord] for coord in range(k)]
    if values != plain:
        raise RuntimeError("the encrypted sum differs from the plain one")
    names = ("encrypt", "sum", "noise", "decrypt", "choose")
    return {n: b - a for n, a, b in zip(names, at, at[1:])} | {"total": at[-1] - at[0], "chosen": len(chosen), "upload_bytes": clients * k * key.public.width}
