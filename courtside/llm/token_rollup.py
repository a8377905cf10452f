"""Token counts by source, language and tokenizer version, kept up by deltas.

A batch of changes (insert, revise, delete of a document's count under a tokenizer version) becomes signed entries: the reverse of what the ledger
holds for the document, and the new count. Entries add up, so totals are sums of the batches' own small sums. A batch is
committed when its sums are written whole (Spark's _SUCCESS mark); a batch id that is committed already changes nothing, and
what a lost run has left of an uncommitted one is overwritten.

Changes without a doc_id are left out, as nothing could revise them. Null texts count 0 tokens, null sources and languages are a group
each. Of several changes to one document and version in a batch, deletes lose to counts and the largest count holds; a delete
of an unknown document changes nothing. Empty batches are committed as empty; very long texts are counted whole; repeated rows of a batch
count once, as they are one change; other columns are ignored. One writer at a time: batches are checked and written, not locked.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
ENTRY = "doc_id long, tokenizer string, source string, lang string, docs long, tokens long"
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"


class TokenLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _paths(self, part: str) -> list[str]:
        """Folders of the committed batches."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sums")
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
        return [f"{self.path}/{part}/{x}" for x in sorted(names) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sums/{x}/_SUCCESS"))]

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = self._paths(part)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def committed(self, batch_id: str) -> bool:
        return f"{self.path}/sums/{batch_id}" in self._paths("sums")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """changes: op (insert, revise or delete), doc_id, tokenizer, source, lang, n_tokens. False if the batch is there already."""
        if self.committed(batch_id):
            return False
        counted = F.when(F.col("op") != "delete", F.struct("n_tokens", "source", "lang"))
        new = changes.where(F.col("doc_id").isNotNull()).groupBy(*KEY).agg(F.max(counted).alias("new"))
        # of the history only what the batch's documents have
        held = self._read("entries", ENTRY).join(new.select(*KEY), KEY, "left_semi").groupBy(*KEY, "source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        undo = held.select(*KEY, "source", "lang", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        put = new.where(F.col("new").isNotNull()).select(*KEY, "new.source", "new.lang", F.lit(1).cast("long").alias("docs"), F.col("new.n_tokens").cast("long").alias("tokens"))
        entries = f"{self.path}/entries/{batch_id}"
        put.unionByName(undo).write.mode("overwrite").parquet(entries)
        sums = self.spark.read.schema(ENTRY).parquet(entries).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/sums/{batch_id}")
        return True

    def totals(self) -> DataFrame:
        sums = self._read("sums", SUMS).groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


#: Tokenizer versions by pattern; a token is a match.
SPACED = r"[^\x20\x09-\x0D]+"
SPLIT = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"


def counts(docs: DataFrame, op: str, tokenizer: str, pattern: str) -> DataFrame:
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(pattern))
    return docs.select(F.lit(op).alias("op"), "doc_id", F.lit(tokenizer).alias("tokenizer"), "source", "lang", n.alias("n_tokens"))


def maintained(docs: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """A ledger's life: two versions' counts come in, the first is revised, toxic documents are taken down, and two batches are sent again."""
    ledger = TokenLedger(docs.sparkSession, path)
    gone = labels.where("toxic = 1").select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("tokenizer"))
    batches = {
        "0001-v1": counts(docs, "insert", "v1", r"[^ ]+"),
        "0002-v2": counts(docs, "insert", "v2", SPLIT),
        "0003-v1-revised": counts(docs, "revise", "v1", SPACED),
        "0004-taken-down": gone.select(F.lit("delete").alias("op"), "doc_id", "tokenizer", *(F.lit(None).cast("string").alias(c) for c in ("source", "lang")), F.lit(None).cast("int").alias("n_tokens")),
    }
    for batch_id in [*batches, "0003-v1-revised", "0004-taken-down"]:
        ledger.commit(batch_id, batches[batch_id])
    return ledger.totals()


ORACLE_SQL = rf"""
with d as (select * from documents where doc_id is not null and doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null)),
t as (select source, lang, 'v1' tokenizer, len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) n from d
      union all select source, lang, 'v2', len(regexp_extract_all(coalesce(text, ''), '{SPLIT}')) from d)
select source, lang, tokenizer, cast(count(*) as bigint) n_docs, cast(sum(n) as bigint) n_tokens from t group by all
"""
