"""A versioned store on plain Parquet: numbered commits, whole document tables, and chunks that are appended.

A commit is a small file ``commits/N`` that names the folder of its documents and the folders of its chunks. It appears by a rename
that fails if another writer was first, and the highest one holds; so a crash at any point leaves the last commit, and nothing that
is written is ever written over. A reader keeps the commit it opened. Chunks of deleted documents stay in their folders until
a commit has ``MOST`` of them and writes what is left anew; folders that none of the last ``KEPT`` commits names are deleted then.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.model import CHUNKS, DOCUMENTS
from brindle.operators.versions import keep_newest_current
from brindle.plans.recovery import delete

#: The schema version that the code works with.
HEAD = 2


#: Chunk folders of a commit at most, and commits that readers can still be reading.
MOST, KEPT = 16, 8


class SchemaError(RuntimeError):
    """The store is of another schema version, or embeddings of another size."""


class ConcurrentWrite(RuntimeError):
    """Another writer was first; what this one read is out of date."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    @property
    def last(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max((int(x) for x in self._names("commits") if x.isdigit()), default=0)

    def _commit(self, n: int) -> dict:
        fs, p = self._fs(f"{self.path}/commits/{n}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, n: int, commit: dict) -> None:
        """Writes commit ``n`` beside its place and moves it there; fails if another writer's is there."""
        fs, fresh = self._fs(f"{self.path}/commits/_{uuid.uuid4().hex}")
        stream = fs.create(fresh)
        stream.write(bytearray(json.dumps(commit).encode()))
        stream.close()
        place = self._fs(f"{self.path}/commits/{n}")[1]
        if fs.exists(place) or not fs.rename(fresh, place):
            fs.delete(fresh, False)
            raise ConcurrentWrite(f"another writer has made commit {n} of {self.path}")

    @property
    def revision(self) -> int | None:
        n = self.last
        return self._commit(n)["schema"] if n else None

    def read(self, name: str) -> DataFrame:
        n = self.last
        schema = {"documents": DOCUMENTS, "chunks": CHUNKS}[name]
        if not n:
            return self.spark.createDataFrame([], schema)
        commit = self._commit(n)
        if commit["documents"] is None:
            return self.spark.createDataFrame([], schema)
        documents = self.spark.read.parquet(f"{self.path}/{commit['documents']}")
        if name == "documents":
            return documents
        if not commit["chunks"]:
            return self.spark.createDataFrame([], schema)
        chunks = self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in commit["chunks"]])
        return chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(*chunks.columns)

    def write(self, documents: DataFrame, chunks: DataFrame | None = None, added: DataFrame | None = None, schema: int = HEAD, base: int | None = None) -> int:
        """A commit of ``documents`` with ``chunks``, all of them, or with ``added``, those beside the stored ones.

        Chunks whose document is not among ``documents`` are not read again. ``base`` is the commit that the data were made from (None: the
        last); if another came after it, ``ConcurrentWrite`` is raised and nothing changes.
        """
        n = (self.last if base is None else base) + 1
        folders = list(self._commit(n - 1)["chunks"]) if n > 1 and chunks is None else []
        own = uuid.uuid4().hex
        documents.write.parquet(f"{self.path}/documents/{own}")
        if chunks is not None or added is not None:
            (chunks if chunks is not None else added).write.parquet(f"{self.path}/chunks/{own}")
            folders.append(f"chunks/{own}")
        try:
            self._publish(n, {"schema": schema, "documents": f"documents/{own}", "chunks": folders})
        except ConcurrentWrite:
            for folder in ("documents", "chunks"):
                delete(self.spark, f"{self.path}/{folder}/{own}")
            raise
        if len(folders) > MOST:
            left = self.read("chunks")
            left.write.parquet(f"{self.path}/chunks/{own}-all")
            n += 1
            self._publish(n, {"schema": schema, "documents": f"documents/{own}", "chunks": [f"chunks/{own}-all"]})
            self._vacuum(n)
        return n

    def _vacuum(self, n: int) -> None:
        """Deletes the folders of commits older than the last ``KEPT``; those of a writer that has yet to publish are younger than any commit."""
        old = [k for k in sorted(int(x) for x in self._names("commits") if x.isdigit()) if k <= n - KEPT]
        named = lambda ks: {x for k in ks for c in [self._commit(k)] for x in (c["documents"], *c["chunks"]) if x}
        for folder in named(old) - named(range(n - KEPT + 1, n + 1)):
            delete(self.spark, f"{self.path}/{folder}")
        for k in old:
            delete(self.spark, f"{self.path}/commits/{k}")

    def check(self, dim: int) -> None:
        """The schema version is ours and stored embeddings have ``dim`` components."""
        if self.revision not in (None, HEAD):
            raise SchemaError(f"schema version {self.revision}, expected {HEAD}: migrate")
        other = self.read("chunks").filter(F.size("embedding") != dim).limit(1).count()
        if other:
            raise SchemaError(f"stored embeddings do not have {dim} components")

    def target(self, name: str | int) -> int:
        """The schema version that ``name`` stands for: head, base (0), a number, or so many steps back (-1) or on (+1)."""
        text, now = str(name), self.revision or 0
        if re.fullmatch(r"[+-]\d+", text):
            to = now + int(text)
        else:
            to = {"head": HEAD, "base": 0}.get(text, int(text) if text.isdigit() else -1)
        if not 0 <= to <= HEAD:
            raise ValueError(f"no schema version {name}: they are base (0) to {HEAD}, head")
        return to

    def migrate(self, to: str | int = HEAD) -> int:
        """Moves the tables to a schema version: 2 has keys, versions and validity, 1 has not, and at 0 there are none."""
        to, base = self.target(to), self.last
        now = self.revision if base else HEAD
        if to == 0:
            self._publish(base + 1, {"schema": 0, "documents": None, "chunks": []})
            return 0
        if now == to and base:
            return to
        documents = self.read("documents")
        if now == 1 and to == 2:
            documents = upgrade_documents(documents)
        elif to == 1 and "doc_key" in documents.columns:
            documents = documents.drop("doc_key", "version", "is_current", "superseded_at", "valid_from", "valid_until", "review_by")
        self.write(documents, schema=to, base=base)
        return to


def upgrade_documents(documents: DataFrame) -> DataFrame:
    """Version columns for documents without them: the file's name is the key, and one document per key stays current."""
    kinds = [("superseded_at", "timestamp"), ("valid_from", "date"), ("valid_until", "date"), ("review_by", "date")]
    wide = documents.withColumn("doc_key", F.col("filename")).withColumn("version", F.lit(1)).withColumn("is_current", F.lit(True))
    for name, kind in kinds:
        wide = wide.withColumn(name, F.lit(None).cast(kind))
    return keep_newest_current(wide, F.current_timestamp())
