"""Stores on Parquet: documents, encodings, vocabularies, result trees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, own_folder


class DuplicateKeys(ValueError):
    """A key that must be unique isn't."""


def check_unique(df: DataFrame, *key: str) -> None:
    """Raise if a key comes twice; stops at the first that does."""
    twice = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise DuplicateKeys(f"{key} comes twice: {twice[0]}")


class DocumentStore:
    """Documents by title. A store holds sentences or whole paragraphs, never both."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self, documents: DataFrame) -> None:
        """Write a new store; one that exists is refused, and so are titles that come twice."""
        check_unique(documents, "title")
        documents.write.mode("errorifexists").parquet(self.path)

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def titles(self) -> DataFrame:
        return self.documents().select("title")

    def _column(self, name: str, titles: DataFrame) -> DataFrame:
        rows = self.documents()
        if name not in rows.columns:
            raise ValueError(f"this store has no {name}")
        return titles.select("title").join(rows.select("title", name), "title", "left")

    def sentences(self, titles: DataFrame) -> DataFrame:
        """(title, sentences), null where a title isn't known."""
        return self._column("sentences", titles)

    def paragraphs(self, titles: DataFrame) -> DataFrame:
        return self._column("paragraphs", titles)


class EncodingStore:
    """Vectors by title and sentence; titles that are known aren't written again unless asked for.

    Each write is a version of its own, in a folder by number. A version that replaces
    the ones before it lists in its ``_base`` file that they no longer count, and is
    read only once it is whole: a job that fails on the way leaves the store as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        """Whole versions from the last one that replaces others on."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        found = sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(path) if f.getPath().getName()[1:].isdigit())
        whole = [n for n in found if fs.exists(hadoop(f"{self.path}/v{n}/_SUCCESS"))]
        bases = [n for n in whole if fs.exists(hadoop(f"{self.path}/base{n}"))]
        return [n for n in whole if not bases or n >= bases[-1]]

    def missing(self, titles: DataFrame) -> DataFrame:
        """Titles without encodings."""
        return titles.join(self.read().select("title").distinct(), "title", "left_anti") if self._versions() else titles

    def append(self, encodings: DataFrame, overwrite: bool = False) -> None:
        """``encodings``: title, par_id, sent_id, vector."""
        versions = self._versions()
        new = max(versions, default=0) + 1
        replaces = False
        if versions and overwrite:
            encodings = self.read().join(encodings.select("title").distinct(), "title", "left_anti").unionByName(encodings)
            replaces = True
        elif versions:
            known = encodings.select("title").distinct().join(self.read(), "title", "left_semi").limit(1).collect()
            if known:
                raise DuplicateKeys(f"{known[0].title} has encodings; pass overwrite to replace them")
        encodings.write.mode("overwrite").parquet(f"{self.path}/v{new}")
        if replaces:  # one small file, made at once, switches to the new version
            fs, _ = self._fs()
            fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/base{new}"), True).close()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/v{n}" for n in self._versions()])


def write_word_counts(counts: DataFrame, path: str) -> None:
    """word, tab, count, the most frequent first."""
    counts.select("word", "n").orderBy(F.desc("n"), "word").write.option("sep", "\t").csv(path)


def write_vocabulary(words: DataFrame, path: str) -> None:
    words.select(F.col(words.columns[0]).cast("string").alias("value")).distinct().orderBy("value").write.text(path)


def write_results(rows: DataFrame, path: str) -> None:
    flat = rows
    for name, kind in rows.dtypes:
        if kind.startswith(("array", "struct", "map")):
            flat = flat.withColumn(name, F.to_json(name))
    flat.write.option("header", True).option("escape", '"').csv(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """One object ``{"answer": {qid: answer}, "sp": {qid: [[title, sentence], ...]}}`` from rows (qid, answer, sp).

    The format is one object in one file, but all tasks make it: each entry is a line of
    its own, and the tasks' files are joined as bytes. The empty file ``_entries`` says so
    to the reader, which then need not read the object whole.
    """
    quoted = lambda c: F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})
    text = lambda c: F.regexp_extract(quoted(c), r'(?s)^\{"x":(.*)\}$', 1)
    fact = lambda f: F.concat(F.lit("["), text(f["title"]), F.lit(", "), f["sent_id"].cast("string"), F.lit("]"))
    name = F.concat(text(F.col("qid").cast("string")), F.lit(": "))
    facts = F.concat(F.lit("["), F.array_join(F.transform("sp", fact), ", "), F.lit("]"))
    one = rows.select(F.concat(name, text(F.col("answer"))).alias("answer"), F.when(F.col("sp").isNotNull(), F.concat(name, facts)).alias("sp"))
    spark = rows.sparkSession
    entry = F.explode(F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("value")) for c in ("answer", "sp")]))
    entries = one.select(entry.alias("e")).select("e.*").where("value is not null")
    parts = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    dealt = entries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "value").sortWithinPartitions("section", "value")
    dealt.select("section", F.concat(F.lit(", "), "value").alias("value")).write.partitionBy("section").text(parts)
    _join_files(spark, parts, path.rstrip("/"))
    delete(spark, parts)


def _join_files(spark: SparkSession, parts: str, path: str) -> None:
    """One file of the lines of both sections; the comma before the first line of each is left out."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    at = lambda name: hadoop.fs.Path(name)
    source, target = at(parts).getFileSystem(conf), at(path).getFileSystem(conf)
    if target.exists(at(path)):
        raise FileExistsError(path)
    out = target.create(at(f"{path}/part-00000.txt"), False)
    for name, edge in (("answer", '{"answer": {\n'), ("sp", '}, "sp": {\n')):
        out.write(bytearray(edge.encode()))
        folder = at(f"{parts}/section={name}")
        files = sorted((f.getPath().getName(), f.getLen()) for f in (source.listStatus(folder) if source.exists(folder) else []))
        for i, file in enumerate(f for f, size in files if f.startswith("part-") and size):
            read = source.open(at(f"{parts}/section={name}/{file}"))
            if not i:
                read.seek(2)
            hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
            read.close()
    out.write(bytearray(b"}}\n"))
    out.close()
    target.create(at(f"{path}/_entries"), True).close()


def write_grid(rows: DataFrame, path: str) -> None:
    """Results of all settings, in folders by n2 and n1."""
    rows.write.partitionBy("n2", "n1").json(path)


def write_postings(index: DataFrame, table: str, buckets: int = 64) -> None:
    """Postings bucketed by term, so that later joins on it need no shuffle of them."""
    index.write.bucketBy(buckets, "term").sortBy("term").mode("overwrite").saveAsTable(table)
