"""A vault with versions: readers see one version whole, writers that met on one session notice and go again.

Every commit adds a folder of Parquet files that is never changed, and a small
manifest that lists the folders of its version.  A version exists once its manifest
has been renamed into place, which fails if another writer was first; the file system
has to refuse a rename onto an existing file, as Structured Streaming's own logs need it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.catalog import Rule
from hushframe.operators.mask import sanitize_scope
from hushframe.operators.skew import cut_lineage, join_null_safe
from hushframe.operators.vault import BUCKETS, VAULT_COLUMNS, refuse_conflicts, session_bucket

_SCHEMA = "session_id string, token string, entity_type string, value string, commit string, bucket int"
# More live folders than this are put together by the commit that makes them.
MAX_FOLDERS = 20


class VaultMoved(RuntimeError):
    """Another writer has committed values of the same sessions since the version that was read."""


@dataclass(frozen=True)
class Version:
    """One version of a vault: its number and the folders that hold it."""

    number: int
    folders: tuple[str, ...]


class VaultStore:
    """The versioned vault under ``path``; ``key`` encrypts values, ``buckets`` must stay the same for a vault."""

    def __init__(self, spark: SparkSession, path: str, key: bytes | None = None, buckets: int = BUCKETS, max_folders: int = MAX_FOLDERS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.key = key
        self.buckets = buckets
        self.max_folders = max_folders
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ---- manifests

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("").getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        files, folder = self._files(), self._at("_versions")
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def _manifest(self, number: int) -> Version:
        stream = self._files().open(self._at(f"_versions/{number:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, tuple(json.loads(text)["folders"]))

    def latest(self) -> Version:
        """The newest version; number 0, without folders, before the first commit."""
        numbers = self._numbers()
        return self._manifest(numbers[-1]) if numbers else Version(0, ())

    def _publish(self, version: Version) -> bool:
        """Rename the manifest into place; false if that version exists already."""
        text = json.dumps({"folders": list(version.folders)})
        draft, final = self._at(f"_drafts/{uuid.uuid4().hex}"), self._at(f"_versions/{version.number:012d}.json")
        files = self._files()
        files.mkdirs(final.getParent())
        out = files.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(draft).toUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(final), plain)
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            files.delete(draft, False)
            return False
        return True

    # ---- reading

    def read(self, version: Version | None = None, sessions: Sequence[str] | None = None) -> DataFrame:
        """``(session_id, token, entity_type, value)`` of one version; with ``sessions`` only the folders of their buckets.

        Rows with a null value only say that a token stands in some text.
        """
        version = version or self.latest()
        if not version.folders:
            return self.spark.createDataFrame([], _SCHEMA).select(*VAULT_COLUMNS)
        rows = self._rows(version.folders)
        if sessions is not None:
            names = [F.lit(name) for name in sessions]
            here = self.spark.range(1).select(F.array(*[session_bucket(name, self.buckets) for name in names])).first()[0] if names else []
            rows = rows.filter(F.col("bucket").isin(sorted(set(here))) & F.col("session_id").isin(*sessions))
        return rows.select(*VAULT_COLUMNS)

    def _rows(self, folders: Iterable[str]) -> DataFrame:
        value = F.col("value")
        if self.key is not None:
            value = F.aes_decrypt(F.unbase64(value), F.lit(self.key)).cast("string")
        paths = [f"{self.path}/data/commit={name}" for name in folders]
        stored = self.spark.read.schema(_SCHEMA).option("basePath", f"{self.path}/data").parquet(*paths)
        return stored.withColumn("value", value)

    # ---- writing

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        value = F.col("value")
        if self.key is not None:
            value = F.base64(F.aes_encrypt(value, F.lit(self.key)))
        (
            rows.select("session_id", "token", "entity_type", value.alias("value"))
            .withColumn("bucket", session_bucket("session_id", self.buckets))
            .hint("rebalance", "bucket")
            .write.partitionBy("bucket").parquet(f"{self.path}/data/commit={name}")
        )
        return name

    def commit(self, pairs: DataFrame, based_on: Version) -> Version:
        """Add vault rows that were numbered against ``based_on``; the new version.

        Commits of other writers in between are let pass if none of them has a session
        of ``pairs``; else ``VaultMoved`` is raised and nothing changes.  A token with two
        values is refused.
        """
        pairs = cut_lineage(pairs.select(*VAULT_COLUMNS).distinct())
        sessions = pairs.select("session_id").distinct()
        refuse_conflicts(pairs.unionByName(join_null_safe(self.read(based_on), sessions, ["session_id"], "left_semi")))
        name = self._write(pairs)
        seen = based_on
        while True:
            now = self.latest()
            others = [folder for folder in now.folders if folder not in seen.folders]
            if others and not join_null_safe(self._rows(others), sessions, ["session_id"], "left_semi").isEmpty():
                raise VaultMoved(f"version {now.number} holds newer values of these sessions than version {based_on.number}")
            seen = now
            made = Version(now.number + 1, (*now.folders, name))
            if self._publish(made):
                return self.compact(made) if len(made.folders) > self.max_folders else made

    def compact(self, version: Version | None = None) -> Version:
        """Write the rows of a version as one folder and publish that; a version newer meanwhile is left as it is."""
        version = version or self.latest()
        if len(version.folders) < 2:
            return version
        name = self._write(self._rows(version.folders))
        made = Version(version.number + 1, (name,))
        return made if self._publish(made) else self.latest()

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders and manifests that none of the newest ``keep`` versions needs; the number of folders deleted.

        Run it when no writer is at work and no reader uses an older version.
        """
        numbers = self._numbers()
        kept = [self._manifest(number) for number in numbers[-keep:]]
        needed = {folder for version in kept for folder in version.folders}
        files, gone = self._files(), 0
        for number in numbers[:-keep]:
            files.delete(self._at(f"_versions/{number:012d}.json"), False)
        if kept and files.exists(self._at("data")):
            for status in files.listStatus(self._at("data")):
                if status.getPath().getName().removeprefix("commit=") not in needed:
                    files.delete(status.getPath(), True)
                    gone += 1
        return gone


def sanitize_into(
    store: VaultStore,
    df: DataFrame,
    id_cols: Sequence[str],
    order_cols: Sequence[str],
    session_cols: Sequence[str] = (),
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    exclusions: Iterable[str] = (),
    attempts: int = 5,
    extra: str | None = None,
) -> tuple[DataFrame, Version]:
    """Mask against the newest version of a vault and commit the new values; goes again if another writer was faster.

    Returns the masked rows and the version that holds all their tokens.
    """
    for left in range(attempts - 1, -1, -1):
        version = store.latest()
        masked, added = sanitize_scope(
            df, id_cols, order_cols, session_cols, text_col, rules, exclusions, vault=store.read(version), extra=extra
        )
        try:
            return masked, store.commit(added, version)
        except VaultMoved:
            if not left:
                raise
    raise ValueError("attempts must be at least 1")


__all__ = ["MAX_FOLDERS", "Version", "VaultMoved", "VaultStore", "sanitize_into"]
