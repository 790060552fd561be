"""The encrypted profile store.

The payload is JSON {version, profiles: {client_id: entry}}, encrypted with
AES-256-GCM. A file is magic (8 bytes), nonce (12), tag (16), ciphertext. The
nonce is drawn on the driver for every save. A vault in a file is sealed and
opened by the driver's own cipher, so neither key nor profile is ever part of a
query plan; the column functions are for tables of payloads, whose keys are the
caller's columns.
"""

from __future__ import annotations

import hashlib
import json
import os
import secrets
import stat
import sys
from datetime import UTC, datetime
from pathlib import Path
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import model
from veilframe.errors import SecurityError, VaultError
from veilframe.profile import Profile, load_profile, parse_profile

MAGIC = b"VEILVLT1"
NONCE, TAG, KEY = 12, 16, 32


class KeyProvider(Protocol):
    def get_or_create_master_key(self) -> bytes: ...

    def delete_master_key(self) -> None: ...


class FileKeys:
    """A key in a file that only its owner may read."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def get_or_create_master_key(self) -> bytes:
        if not self.path.exists():
            self.path.parent.mkdir(parents=True, exist_ok=True)
            fd = os.open(self.path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
            with os.fdopen(fd, "w") as f:
                f.write(secrets.token_hex(KEY))
        check_mode(self.path)
        return bytes.fromhex(self.path.read_text().strip())

    def delete_master_key(self) -> None:
        self.path.unlink(missing_ok=True)


class EnvironmentKeys:
    """A key in hex in an environment variable."""

    def __init__(self, name: str = "VEILFRAME_KEY"):
        self.name = name

    def get_or_create_master_key(self) -> bytes:
        if self.name not in os.environ:
            raise VaultError(f"{self.name} is not set")
        return bytes.fromhex(os.environ[self.name])

    def delete_master_key(self) -> None:
        os.environ.pop(self.name, None)


def key_provider(home: str | Path, platform: str = sys.platform) -> KeyProvider:
    """Keys by platform: the stores of operating systems are out of scope, so a file or the environment."""
    return EnvironmentKeys() if "VEILFRAME_KEY" in os.environ else FileKeys(Path(home) / "master.key")


def check_mode(path: Path) -> None:
    if os.name == "posix" and stat.S_IMODE(path.stat().st_mode) & 0o077:
        raise SecurityError(f"others may read {path}; chmod 600 it")


def now() -> str:
    return datetime.now(UTC).isoformat()


def empty_payload() -> dict:
    return {"version": 1, "profiles": {}}


def vault_id(path: str | Path) -> str:
    return hashlib.sha256(str(path).encode()).hexdigest()[:16]


# Columns: the same store as a table, for many payloads at once.


def encrypt(payload: Column, key: Column, nonce: Column) -> Column:
    """magic, nonce, tag, ciphertext; the nonce is an input, so the lazy expression may be read repeatedly."""
    sealed = F.aes_encrypt(payload.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce)  # nonce, ciphertext, tag
    n = F.octet_length(sealed)
    body = F.substr(sealed, F.lit(NONCE + 1), n - NONCE - TAG)
    return F.concat(F.lit(MAGIC), nonce, F.substr(sealed, n - TAG + 1, F.lit(TAG)), body)


def decrypt(blob: Column, key: Column) -> tuple[Column, Column]:
    """(payload, error): exactly one of them is null."""
    n, head = F.octet_length(blob), len(MAGIC)
    sealed = F.concat(F.substr(blob, F.lit(head + 1), F.lit(NONCE)), F.substr(blob, F.lit(head + NONCE + TAG + 1), n), F.substr(blob, F.lit(head + NONCE + 1), F.lit(TAG)))
    short = n < head + NONCE + TAG
    opened = F.when(~short, F.try_aes_decrypt(sealed, key, F.lit("GCM"))).cast("string")
    magic = F.substr(blob, F.lit(1), F.lit(head)) == F.lit(MAGIC)
    error = F.when(blob.isNull() | short, "too short").when(~magic, "not a vault").when(opened.isNull(), "wrong key or tampered")
    return F.when(error.isNull(), opened), error


def parse(payload: Column) -> Column:
    return F.from_json(payload, model.VAULT)


def add_entry(profiles: Column, client: str, entry: Column) -> Column:
    """The map with the entry; null if the client is known already."""
    return F.when(~F.map_contains_key(profiles, client), F.map_concat(profiles, F.create_map(F.lit(client), entry)))


def get_entry(profiles: Column, client: str) -> Column:
    return F.try_element_at(profiles, F.lit(client))


def delete_entry(profiles: Column, client: str) -> Column:
    return F.map_filter(profiles, lambda k, _: k != client)


def update_entry(profiles: Column, client: str, profile_json: Column, at: Column) -> Column:
    """The map with another body and time for the client; null if it is not known."""
    new = lambda v: F.struct(v["display_name"].alias("display_name"), v["created_at"].alias("created_at"), at.alias("updated_at"), profile_json.alias("profile_json"), v["notes"].alias("notes"))
    return F.when(F.map_contains_key(profiles, client), F.transform_values(profiles, lambda k, v: F.when(k == client, new(v)).otherwise(v)))


def rename_entry(profiles: Column, old: str, new: str) -> Column:
    """The map with the entry under its new name; null if the old is missing or the new one taken."""
    able = F.map_contains_key(profiles, old) & ~F.map_contains_key(profiles, new)
    return F.when(able, F.map_concat(delete_entry(profiles, old), F.create_map(F.lit(new), profiles[old])))


def list_entries(payloads: DataFrame, profiles: str = "profiles", *keep: str) -> DataFrame:
    """(columns kept, client_id, display_name, created_at, updated_at) without bodies."""
    out = payloads.select(*keep, F.explode(F.map_entries(profiles)).alias("e"))
    return out.select(*keep, F.col("e.key").alias("client_id"), *[F.col(f"e.value.{c}").alias(c) for c in ("display_name", "created_at", "updated_at")])


class Vault:
    """One store in a file."""

    def __init__(self, spark: SparkSession, path: str | Path, keys: KeyProvider):
        self.spark, self.path, self.keys = spark, Path(path), keys

    def _key(self) -> bytes:
        key = self.keys.get_or_create_master_key()
        if len(key) != KEY:
            raise VaultError(f"a master key has {KEY} bytes, not {len(key)}")
        return key

    def _cipher(self, mode: int, nonce: bytes):
        """The JVM's AES-GCM for this key; nothing of it reaches Spark."""
        crypto = self.spark._jvm.javax.crypto
        out = crypto.Cipher.getInstance("AES/GCM/NoPadding")
        out.init(mode, crypto.spec.SecretKeySpec(self._key(), "AES"), crypto.spec.GCMParameterSpec(8 * TAG, nonce))
        return out

    def seal(self, data: bytes) -> bytes:
        nonce = secrets.token_bytes(NONCE)
        sealed = bytes(self._cipher(1, nonce).doFinal(data))
        return MAGIC + nonce + sealed[-TAG:] + sealed[:-TAG]

    def unseal(self, blob: bytes) -> str:
        start = len(MAGIC) + NONCE + TAG
        if len(blob) < start:
            raise VaultError(f"{self.path}: too short")
        if not blob.startswith(MAGIC):
            raise VaultError(f"{self.path}: not a vault")
        cipher = self._cipher(2, blob[len(MAGIC) : start - TAG])
        try:
            return bytes(cipher.doFinal(blob[start:] + blob[start - TAG : start])).decode()
        except Py4JJavaError:
            raise VaultError(f"{self.path}: wrong key or tampered") from None

    def open(self) -> dict:
        if not self.path.exists():
            return empty_payload()
        check_mode(self.path)
        return json.loads(self.unseal(self.path.read_bytes()))

    def save(self, payload: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        new = self.path.with_suffix(".new")
        fd = os.open(new, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
        with os.fdopen(fd, "wb") as f:
            f.write(self.seal(json.dumps(payload).encode()))
            f.flush()
            os.fsync(f.fileno())
        os.replace(new, self.path)
        salt = self.path.with_suffix(".salt")  # part of the file layout; nothing is derived from it
        if not salt.exists():
            with os.fdopen(os.open(salt, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
                f.write(secrets.token_bytes(KEY))

    def add_profile(self, client: str, profile: Profile, display_name: str = "", notes: str = "") -> None:
        payload = self.open()
        if client in payload["profiles"]:
            raise VaultError(f"profile {client} exists")
        at = now()
        payload["profiles"][client] = {"display_name": display_name or profile.subject.display_name, "created_at": at, "updated_at": at, "profile_json": profile.model_dump_json(), "notes": notes}
        self.save(payload)

    def get_profile(self, client: str) -> Profile | None:
        entry = self.open()["profiles"].get(client)
        return parse_profile(json.loads(entry["profile_json"])) if entry else None

    def list_profiles(self) -> list[dict]:
        return [{"client_id": k} | {c: v[c] for c in ("display_name", "created_at", "updated_at")} for k, v in self.open()["profiles"].items()]

    def delete_profile(self, client: str) -> None:
        payload = self.open()
        if payload["profiles"].pop(client, None) is not None:
            self.save(payload)

    def update_profile(self, client: str, profile: Profile) -> None:
        payload = self.open()
        if client not in payload["profiles"]:
            raise VaultError(f"no profile {client}")
        payload["profiles"][client] |= {"profile_json": profile.model_dump_json(), "updated_at": now()}
        self.save(payload)

    def rename_profile(self, old: str, new: str) -> None:
        payload = self.open()
        entries = payload["profiles"]
        if old not in entries or new in entries:
            raise VaultError(f"no profile {old}" if old not in entries else f"profile {new} exists")
        entries[new] = entries.pop(old)
        self.save(payload)


def secure_wipe(path: str | Path, passes: int = 3) -> None:
    """Overwrite a file with random bytes and remove it."""
    path = Path(path)
    if not path.exists():
        return
    size = path.stat().st_size
    with path.open("r+b") as f:
        for _ in range(passes):
            f.seek(0)
            f.write(secrets.token_bytes(size))
            f.flush()
            os.fsync(f.fileno())
    path.unlink()


def migrate_profile(vault: Vault, source: str | Path, client: str | None = None, dry_run: bool = False, keep_source: bool = False) -> str:
    """A YAML profile into the vault: `added` or `updated`; the source is wiped unless kept."""
    profile = load_profile(source)
    client = client or Path(source).stem
    known = client in vault.open()["profiles"]
    if not dry_run:
        vault.update_profile(client, profile) if known else vault.add_profile(client, profile)
        if not keep_source:
            secure_wipe(source)
    return "updated" if known else "added"
