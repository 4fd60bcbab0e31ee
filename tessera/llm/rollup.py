"""Token counts kept as additive totals by source, language and tokenizer version, from signed batches."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranked
from .store import binary_text, bounded_batches, drop, shared_dir, table

KEYS = ("source", "lang", "version")
#: Ids up to which a list is broadcast; beyond it texts meet it in a shuffle.
BROADCAST_ROWS = 1_000_000


class TokenLedger:
    """Committed batches of deltas below ``root``; the totals are their sum.

    A batch is written to a folder of its own and committed by one atomic rename that fails
    where the batch's name exists: a repeated batch, a restarted job or a second writer
    changes nothing. ``compact`` folds batches into a snapshot that lists their names, and
    later reads skip these.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{root}/{p}")
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), spark._jsc.hadoopConfiguration())
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _commit(self, df: DataFrame, to: str, note: str = "") -> bool:
        temp = f"_pending/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{temp}")
        if note:
            out = self._fs.create(self._path(f"{temp}/_note"))
            out.write(bytearray(note.encode()))
            out.close()
        self._fs.mkdirs(self._path(to.rpartition("/")[0]))
        kind = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            self._files.rename(self._path(temp), self._path(to), self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            drop(self.spark, f"{self.root}/{temp}")
            return False
        return True

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit signed changes (source, lang, version, sign, n_tokens) once; False if the batch was there already.

        An insert has sign 1, a delete -1 with the count it had, a revision is one of each.
        Null counts are 0; null keys are keys of their own. Aggregated before the shuffle.
        """
        if batch in self.batches():
            return False
        n = F.coalesce(F.col("n_tokens"), F.lit(0)) * F.col("sign")
        delta = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(n).cast("long").alias("n_tokens"))
        return self._commit(delta, f"batches/{batch}")

    def _snapshot(self) -> tuple[str | None, list[str]]:
        names = self._names("snapshots")
        if not names:
            return None, []
        stream = self._fs.open(self._path(f"snapshots/{names[-1]}/_note"))
        note = bytes(stream.readAllBytes()).decode()
        stream.close()
        return names[-1], json.loads(note)

    def batches(self) -> list[str]:
        return sorted({*self._names("batches"), *self._snapshot()[1]})

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) of all that is committed; groups that came to nothing are left out."""
        snap, folded = self._snapshot()
        return self._sum(snap, [b for b in self._names("batches") if b not in folded])

    def _sum(self, snap: str | None, names: list[str]) -> DataFrame:
        """Totals of one snapshot and the named batches."""
        paths = [f"{self.root}/batches/{b}" for b in names] + ([f"{self.root}/snapshots/{snap}"] if snap else [])
        schema = "source string, lang string, version string, n_docs long, n_tokens long"
        if not paths:
            return self.spark.createDataFrame([], schema)
        sums = self.spark.read.schema(schema).parquet(*paths).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 OR n_tokens != 0")

    def compact(self) -> None:
        """Fold the committed batches into one snapshot; what it replaces is removed after it is committed.

        The batches are listed once: one that is committed meanwhile is neither in the sums nor in the note.
        """
        snap, folded = self._snapshot()
        present, new = self._names("batches"), f"{int(snap or 0) + 1:012d}"
        if self._commit(self._sum(snap, [b for b in present if b not in folded]), f"snapshots/{new}", json.dumps(sorted({*present, *folded}))):
            for b in present:
                drop(self.spark, f"{self.root}/batches/{b}")
            if snap:
                drop(self.spark, f"{self.root}/snapshots/{snap}")


def counted(docs: DataFrame, versions: dict[str, str], pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, source, lang, version, n_tokens): a row for each document and tokenizer version (name and rank file), whole texts encoded."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = [x.decode() for x in b.column(3).to_pylist()]
            for name, path in versions.items():
                n = pa.array([ranked.count(x, path, pattern) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([name] * len(texts)), n], names=["doc_id", "source", "lang", "version", "n_tokens"])

    slim = docs.select("doc_id", "source", "lang", binary_text(text).alias("t"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, source string, lang string, version string, n_tokens long")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.withColumn("sign", F.lit(sign))


def op3_token_counts(docs: DataFrame, labels: DataFrame, root: str, versions: dict[str, str], pattern: str) -> DataFrame:
    """Totals after four batches, two of them sent twice.

    load: all documents under all tokenizer versions. retract: documents labelled toxic.
    revise: other documents labelled of low quality, now without repeats of a line. Null and empty
    texts count 0 tokens; null sources and languages are keys of their own; a document without an id is
    loaded and never revised; a label without a document changes nothing; repeated rows count each time,
    repeated labels once. An empty table of documents gives no rows, an empty one of labels changes
    nothing; extra columns are ignored. A very long text is encoded whole in one task.
    """
    spark = docs.sparkSession
    ledger = TokenLedger(spark, root)
    docs = docs.select("doc_id", "source", "lang", "text")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    poor = labels.where("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    # counts are recorded once; deletes and revisions take back what was recorded, in rows without texts
    recorded = f"{root}/counts"
    first = counted(docs, versions, pattern)
    first.write.mode("overwrite").parquet(recorded)
    counts = spark.read.schema(first.schema).parquet(recorded)
    load = signed(counts, 1)
    ledger.apply("0-load", load)
    ledger.apply("0-load", load)
    ledger.apply("1-retract", signed(counts.join(toxic, "doc_id", "left_semi"), -1))
    ids = F.broadcast(poor) if poor.count() <= BROADCAST_ROWS else poor
    new = docs.join(ids, "doc_id", "left_semi").withColumn("text", F.array_join(F.array_distinct(F.split("text", "\n")), "\n"))
    revise = signed(counts.join(poor, "doc_id", "left_semi"), -1).unionByName(signed(counted(new, versions, pattern), 1))
    ledger.apply("2-revise", revise)
    ledger.compact()
    ledger.apply("2-revise", revise)
    return ledger.totals()
