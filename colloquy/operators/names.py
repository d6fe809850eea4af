"""Small predicates and lookups over ids, names, builds, processes and places."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose log values are hidden.
SECRET_KEYS = ("token", "secret", "password", "authorization", "api_key", "apikey", "private_key", "cookie", "session_key", "signature", "bearer")
MOST_NAME = 64


def displayable(name: Column) -> Column:
    """1 to 64 characters without control or direction-changing ones."""
    return F.coalesce((F.length(name) >= 1) & (F.length(name) <= MOST_NAME) & ~F.rlike(name, F.lit("[\\p{Cc}\\u061C\\u200E\\u200F\\u202A-\\u202E\\u2066-\\u2069]")), F.lit(False))


def valid_address(address: Column) -> Column:
    """Machine, runtime and native id, none empty; the native id may hold slashes."""
    return F.rlike(address, F.lit("^[^/]+/[^/]+/.+"))


def is_conversation(address: Column) -> Column:
    return F.startswith(F.element_at(F.split(address, "/"), -1), F.lit("conv-"))


def compare_builds(mine: Column, theirs: Column) -> Column:
    """Same, Different, or Unknown when either is missing or was built from changed sources."""
    clean = lambda c: c.isNotNull() & ~F.endswith(c, F.lit("-dirty"))
    return F.when(clean(mine) & clean(theirs), F.when(mine == theirs, "Same").otherwise("Different")).otherwise("Unknown")


def match_processes(processes: DataFrame, signatures: list[tuple[str, str]]) -> DataFrame:
    """Runtime of each process (``pid``, ``tty``, ``command``): the first signature that fits; the last row per terminal.

    A signature ``=x`` is the whole command, any other a part of it, both in any case. Processes
    without a terminal drop out.
    """
    command = F.lower("command")
    hit = F.coalesce(*[F.when(command == s[1:].lower() if s.startswith("=") else F.contains(command, F.lit(s.lower())), F.lit(r)) for s, r in signatures])
    rows = processes.withColumns({"tty": F.regexp_replace("tty", "^/dev/", ""), "runtime_id": hit}).where("runtime_id is not null and tty not in ('?', '??')")
    return rows.groupBy("tty").agg(F.max_by(F.struct("pid", "runtime_id"), "pid").alias("p")).select("tty", "p.*")


def with_alias(live: DataFrame, alias: DataFrame) -> DataFrame:
    """Live sessions with the latest name given to their folder."""
    named = alias.groupBy("cwd").agg(F.max_by("name", "at").alias("alias"))
    return live.join(named, "cwd", "left")


def touch_peers(peers: DataFrame, seen: DataFrame) -> DataFrame:
    """Peers with the last address and time they were seen at; unknown devices are never added."""
    last = seen.groupBy("device_id").agg(F.max_by("addr", "at").alias("_addr"), F.max("at").alias("_at"))
    return peers.join(last, "device_id", "left").select("device_id", F.coalesce("_addr", "addr").alias("addr"), F.coalesce("_at", "last_seen_at").alias("last_seen_at"))


def index_status(turns: DataFrame, indexed: DataFrame) -> DataFrame:
    """Turns indexed, newest of them, newest of all, and whether the index lags by over an hour."""
    keys = indexed.select("session_id", "seq")
    have = turns.join(keys, ["session_id", "seq"]).agg(F.count(F.lit(1)).alias("indexed"), F.max("ts").alias("indexed_until"))
    every = turns.agg(F.max("ts").alias("newest"))
    return have.crossJoin(every).withColumn("stale", F.col("newest") - F.col("indexed_until") > 3_600_000)


def snapshot(df: DataFrame, path: str) -> int:
    """Write a backup that must not exist yet; the number of rows, known only after success."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def censor(fields: Column) -> Column:
    """A map of log fields with the values of secret keys hidden."""
    secret = lambda k: F.lower(k).isin(*SECRET_KEYS)
    return F.transform_values(fields, lambda k, v: F.when(secret(k), "[redacted]").otherwise(v))


#: The hash function's initial words, its message permutation and its flags.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _ROOT, _CHUNK = 1, 2, 8, 1024
#: Base32: the letters that a hash of 256 bits takes.
_BASE32, _LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", np.uint8), 52


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def hashes(keys: np.ndarray) -> np.ndarray:
    """BLAKE3 of keys of one length, up to one chunk of bytes, all at once; keys are far shorter.

    Keys and hashes are rows of bytes. The four columns, then the four diagonals, of all keys are turned together.
    """
    n, size = keys.shape
    if size > _CHUNK:
        raise ValueError("only one chunk can be hashed")
    many = max(1, -(-size // 64))
    padded = np.zeros((n, 64 * many), np.uint8)
    padded[:, :size] = keys
    words = np.ascontiguousarray(padded.view("<u4").T).reshape(many, 16, n)
    lanes = np.arange(4)
    chain = np.repeat(np.array(_IV, np.uint32)[:, None], n, 1)
    for i in range(many):
        flags = (_START if i == 0 else 0) | (_END | _ROOT if i == many - 1 else 0)
        a, b, c = chain[:4], chain[4:], np.repeat(np.array(_IV[:4], np.uint32)[:, None], n, 1)
        d = np.repeat(np.array([0, 0, min(64, size - 64 * i), flags], np.uint32)[:, None], n, 1)
        m = words[i]
        for _ in range(7):
            for first, shift in ((0, 0), (8, 1)):
                b, c, d = b[(lanes + shift) % 4], c[(lanes + 2 * shift) % 4], d[(lanes + 3 * shift) % 4]
                for word, one, two in ((m[first : first + 8 : 2], 16, 12), (m[first + 1 : first + 8 : 2], 8, 7)):
                    a = a + b + word
                    d = _turn(d ^ a, one)
                    c = c + d
                    b = _turn(b ^ c, two)
                b, c, d = b[(lanes - shift) % 4], c[(lanes - 2 * shift) % 4], d[(lanes - 3 * shift) % 4]
            m = m[list(_PERMUTATION)]
        chain = np.concatenate([a ^ c, b ^ d])
    return np.ascontiguousarray(chain.T).astype("<u4", copy=False).view(np.uint8)


def blake3(data: bytes) -> bytes:
    return hashes(np.frombuffer(data, np.uint8)[None, :]).tobytes()


def fingerprints_of(keys: list[bytes]) -> list[str]:
    """Devices' public keys as people compare them: their hashes in base32, in groups of four."""
    out: list[str] = [""] * len(keys)
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        found = hashes(np.frombuffer(b"".join(keys[i] for i in at.tolist()), np.uint8).reshape(len(at), n))
        bits = np.pad(np.unpackbits(found, axis=1), ((0, 0), (0, _LETTERS * 5 - 256))).reshape(len(at), _LETTERS, 5)
        letters = _BASE32[bits @ np.array([16, 8, 4, 2, 1], np.uint8)].reshape(len(at), -1, 4)
        text = np.pad(letters, ((0, 0), (0, 0), (0, 1)), constant_values=ord("-")).reshape(len(at), -1)[:, :-1]
        for i, one in zip(at.tolist(), np.ascontiguousarray(text).view(f"S{text.shape[1]}").ravel().tolist(), strict=True):
            out[i] = one.decode()
    return out


def fingerprint_of(key: bytes) -> str:
    return fingerprints_of([key])[0]


def fingerprint(key: Column) -> Column:
    @F.pandas_udf("string")
    def run(keys: pd.Series) -> pd.Series:
        known = keys[keys.notna()]
        return pd.Series(fingerprints_of(list(map(bytes, known))), known.index, object).reindex(keys.index, fill_value=None)

    return run(key)
